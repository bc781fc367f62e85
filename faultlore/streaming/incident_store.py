"""Incident summaries that are kept up to date while lines arrive.

Of each incident one small record per rule is kept: counts, the highest score, and
the first line by (``event_time``, ``log_id``).  Records merge in any order, so late files
change nothing but what they add.  A micro-batch is first summed per incident and
rule, then merged into the buckets it touches, and only the summaries of its own
incidents are written again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultlore.catalogue import BUILTIN_RULES, Rule
from faultlore.operators import incidents as inc
from faultlore.operators.explaining import assess_logs
from faultlore.sources.stored import bucket_of, replace_partitions, stored_table, values_of

RECORDS = ("incident_id string, rank int, total_logs long, max_score int, high_scores long, critical_scores long, "
           "critical_logs long, high_logs long, first_seq struct<event_time: timestamp, log_id: long>, last_time timestamp, "
           "batch long, bucket int")
COLUMNS = [c.split()[0] for c in RECORDS.replace("struct<event_time: timestamp, log_id: long>", "struct").split(", ")]
BUCKETS = 64


def _records(assessed: DataFrame, buckets: int) -> DataFrame:
    order = F.struct("event_time", "log_id")
    counts = inc.incident_rule_counts(assessed, order, F.max("seq.event_time").alias("last_time"))
    return counts.withColumn("bucket", bucket_of("incident_id", buckets))


def merge_records(assessed: DataFrame, path: str, batch: int, buckets: int = BUCKETS, expiry: dt.timedelta | None = None) -> DataFrame:
    """Merge lines into the records under ``path``; returns the records of the incidents that have changed.

    ``assessed``: incident_id, log_id, event_time, rank, severity, severity_score.  A bucket
    that has this batch already, from an attempt that failed later, is left as it is.
    Incidents without a line for ``expiry`` before the batch's latest are no longer kept.
    """
    spark = assessed.sparkSession
    fresh = _records(assessed, buckets).withColumn("batch", F.lit(batch).cast("long"))
    touched = values_of(fresh, "bucket")
    kept = stored_table(spark, f"{path}/records", RECORDS).filter(F.col("bucket").isin(touched))
    done = [r[0] for r in kept.groupBy("bucket").agg(F.max("batch").alias("batch")).filter(F.col("batch") >= batch).collect()]
    if expiry is not None and touched:
        newest = fresh.agg(F.max("last_time")).first()[0]
        open_still = kept.groupBy("incident_id").agg(F.max("last_time").alias("_last")).filter(F.col("_last") >= F.lit(newest - expiry))
        kept = kept.join(open_still.select("incident_id"), "incident_id", "left_semi")
    both = kept.select(*COLUMNS).unionByName(fresh.select(*COLUMNS)).filter(~F.col("bucket").isin(done))
    merged = both.groupBy("incident_id", "rank", "bucket").agg(
        F.max("max_score").alias("max_score"), *[F.sum(c).alias(c) for c in inc.SUMMED],
        F.min("first_seq").alias("first_seq"), F.max("last_time").alias("last_time"))
    merged = merged.withColumn("batch", F.lit(batch).cast("long"))
    replace_partitions(merged.select(*COLUMNS), f"{path}/records", "bucket")
    changed = fresh.select("incident_id").distinct()
    now = stored_table(spark, f"{path}/records", RECORDS).filter(F.col("bucket").isin(touched))
    return now.join(changed, "incident_id", "left_semi")


def update_summaries(assessed: DataFrame, path: str, batch: int, buckets: int = BUCKETS, expiry: dt.timedelta | None = None,
                     rules: Sequence[Rule] = BUILTIN_RULES, correlations: Sequence[inc.Correlation] = inc.CORRELATIONS) -> None:
    """Merge a batch of lines and write the summaries of its incidents, as rows of this batch."""
    changed = merge_records(assessed, path, batch, buckets, expiry)
    seen = inc.incident_facts_of(inc.incident_rules_of(changed), rules, correlations)
    summaries = inc.incident_summary_of(seen, rules).withColumn("batch", F.lit(batch).cast("long"))
    replace_partitions(summaries, f"{path}/summaries", "batch")


def stream_incident_summary(logs: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", buckets: int = BUCKETS,
                            expiry: dt.timedelta | None = None, rules: Sequence[Rule] = BUILTIN_RULES,
                            correlations: Sequence[inc.Correlation] = inc.CORRELATIONS) -> StreamingQuery:
    """Keep one summary per incident of a stream (log_id, incident_id, event_time, raw_log) under ``path``.

    A line whose ``log_id`` has come before, at most ``late`` ago, counts once; lines later
    than that are left out.  ``expiry``, if given, should be longer than ``late``.
    """
    columns = ("log_id", "incident_id", "event_time", "rank", "severity", "severity_score")
    once = (assess_logs(logs, rules).select(*columns).withWatermark("event_time", late)
            .dropDuplicatesWithinWatermark(["log_id"]))

    def update(lines: DataFrame, batch: int) -> None:
        lines = lines.persist()
        try:
            update_summaries(lines, path, batch, buckets, expiry, rules, correlations)
        finally:
            lines.unpersist()

    return (once.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The latest summary of each incident."""
    written = spark.read.parquet(f"{path}/summaries")
    latest = written.groupBy("incident_id").agg(F.max_by(F.struct(*(c for c in written.columns if c != "batch")), "batch").alias("s"))
    return latest.select("s.*")
