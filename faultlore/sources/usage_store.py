"""Request facts recorded as they happen, and reports that need not read them again.

Three tables under one folder: ``facts`` by day and batch, ``partials`` by day (requests
per key, day and endpoint), and ``last_used`` by bucket of keys.  A batch is named by
its number: recording it again replaces its own rows and no others.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultlore.functions.text import utc_day
from faultlore.operators import usage as us
from faultlore.sources.stored import bucket_of, replace_partitions, stored_table, values_of

PARTIALS = "api_key_id {key}, endpoint string, requests long, successful long, response_ms long, last_used {at}, day date"
LAST_USED = "api_key_id {key}, last_used_at {at}, bucket int"
#: Partitions of the keys' last use.
BUCKETS = 64


def _ddl(text: str, facts: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in facts.schema}
    return text.format(key=kinds["api_key_id"], at=kinds["created_at"])


def append_batch(facts: DataFrame, path: str, batch: int) -> list[dt.date]:
    """Store ``facts`` as batch number ``batch``, by day (UTC); returns the days it has rows for.

    Rows that an earlier attempt stored under this number are replaced.
    """
    dated = facts.withColumns({"day": utc_day(facts, "created_at"), "batch": F.lit(batch)})
    replace_partitions(dated, f"{path}/facts", "day", "batch")
    return values_of(dated.filter("day IS NOT NULL"), "day")


def read_facts(spark: SparkSession, path: str, schema: str, days: list[dt.date] | None = None) -> DataFrame:
    """All recorded facts, or those of some days, of which alone the files are read."""
    facts = stored_table(spark, f"{path}/facts", f"{schema}, day date, batch int")
    return facts if days is None else facts.filter(F.col("day").isin(days))


def refresh_partials(facts: DataFrame, path: str, days: list[dt.date]) -> None:
    """Sum the facts of ``days`` anew; the partials of all other days stay as they are."""
    changed = facts.filter(F.col("day").isin(days)) if "day" in facts.columns else \
        facts.filter(utc_day(facts, "created_at").isin(days))
    replace_partitions(us.day_partials(changed).withColumn("day", F.col("day").cast("date")), f"{path}/partials", "day")


def merge_last_used(facts: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Take the latest use of each key in ``facts`` into the stored one; returns the buckets written.

    Only the buckets of these keys are read and written.  Taking the same facts again changes nothing.
    """
    spark = facts.sparkSession
    fresh = us.last_used_per_key(facts).filter("api_key_id IS NOT NULL").withColumn("bucket", bucket_of("api_key_id", buckets))
    touched = values_of(fresh, "bucket")
    known = stored_table(spark, f"{path}/last_used", _ddl(LAST_USED, facts)).filter(F.col("bucket").isin(touched))
    merged = known.unionByName(fresh).groupBy("api_key_id", "bucket").agg(F.max("last_used_at").alias("last_used_at"))
    replace_partitions(merged, f"{path}/last_used", "bucket")
    return touched


def read_last_used(spark: SparkSession, path: str, facts: DataFrame) -> DataFrame:
    """``api_key_id, last_used_at`` of all keys; ``facts`` tells the types."""
    return stored_table(spark, f"{path}/last_used", _ddl(LAST_USED, facts)).select("api_key_id", "last_used_at")


def record_batch(facts: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> None:
    """Append a batch of facts and bring partials and last use up to date."""
    spark, schema = facts.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in facts.schema)
    days = append_batch(facts, path, batch)
    refresh_partials(read_facts(spark, path, schema, days), path, days)
    merge_last_used(facts, path, buckets)


def record_usage(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS,
                 after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Record a stream of facts under ``path``, each micro-batch by its number, until the data at hand is done.

    A micro-batch that is repeated after a failure replaces its own rows.
    """
    def record(facts: DataFrame, batch: int) -> None:
        facts = facts.persist()
        try:
            record_batch(facts, path, batch, buckets)
            if after is not None:
                after(facts, batch)
        finally:
            facts.unpersist()

    return (stream.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def usage_stats_stored(spark: SparkSession, path: str, facts: DataFrame, keys: DataFrame, as_of: dt.datetime,
                       days: int = us.DEFAULT_DAYS, users: DataFrame | None = None) -> DataFrame:
    """The usage report of every owner from the partials: at most ``days`` days of them.

    The look-back begins inside a day; of that day alone facts are read.  ``facts`` is the
    table that ``read_facts`` returns, ``as_of`` a time in UTC.
    """
    since = as_of - dt.timedelta(days=days)
    first = since.date()
    partials = stored_table(spark, f"{path}/partials", _ddl(PARTIALS, facts)).filter(F.col("day") > F.lit(first))
    edge = us.day_partials(facts.filter((F.col("day") == F.lit(first)) & (F.col("created_at") >= _at(since, facts))))
    whole = partials.withColumn("day", F.date_format("day", "yyyy-MM-dd")).unionByName(edge)
    return us.usage_stats_of(us.owned(whole, keys), keys, users)


def _at(time: dt.datetime, facts: DataFrame) -> Column:
    text = F.lit(time.isoformat(sep=" "))
    if facts.schema["created_at"].dataType.simpleString() == "timestamp_ntz":
        return F.to_timestamp_ntz(text)
    return F.to_timestamp(F.concat(text, F.lit("+00:00")))
