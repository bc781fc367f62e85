"""Tables kept up to date: usage as it is recorded, and incident summaries while lines arrive."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from checks.sample_logs import sample_logs
from faultlore.operators import incidents as inc
from faultlore.operators import usage as us
from faultlore.operators.explaining import assess_logs
from faultlore.sources import usage_store
from faultlore.sources.stored import bucket_of, replace_partitions, stored_table
from faultlore.streaming import incident_store

START = dt.datetime(2024, 1, 10)
FACTS = "api_key_id string, endpoint string, status_code int, response_time_ms int, created_at timestamp"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def facts_of(spark, seed, n, first_day=0, days=8):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(9)}", rng.choice("xyz"), rng.choice([200, 302, 404, 500]), rng.choice([None, 5, 80]),
             START + dt.timedelta(days=first_day + rng.randrange(days), seconds=rng.randrange(86400))) for _ in range(n)]
    return spark.createDataFrame(rows, FACTS)


def keys_of(spark):
    return spark.createDataFrame([(f"k{i}", f"u{i % 3}") for i in range(11)], "id string, user_id string")


def plain(df):
    return sorted(map(repr, df.collect()))


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored_table(spark, path, "a int, p int").collect() == []
    replace_partitions(spark.createDataFrame([(1, 1), (2, 2)], "a int, p int"), path, "p")
    before = files(path)
    replace_partitions(stored_table(spark, path, "a int, p int").filter("p = 2").withColumn("a", F.col("a") + 5), path, "p")
    assert sorted(map(tuple, stored_table(spark, path, "a int, p int").collect())) == [(1, 1), (7, 2)]
    kept = {f for f in before if "p=1" in f}
    assert kept and all(files(path)[f] == before[f] for f in kept)


def test_a_repeated_batch_replaces_its_own_rows(spark, tmp_path):
    path, schema = str(tmp_path), FACTS
    one, two = facts_of(spark, 1, 60), facts_of(spark, 2, 40)
    for batch, facts in ((0, one), (1, two), (1, two), (0, one)):
        usage_store.record_batch(facts, path, batch)
    recorded = usage_store.read_facts(spark, path, schema)
    assert plain(recorded.drop("day", "batch")) == plain(one.union(two))
    assert plain(usage_store.read_last_used(spark, path, one)) == plain(us.last_used_per_key(one.union(two)))
    # rows of other batches stay as they were written
    before = files(f"{path}/facts")
    usage_store.append_batch(two, path, 1)
    assert all(t == before[f] for f, t in files(f"{path}/facts").items() if "batch=0" in f)


def test_reports_from_partials_as_from_all_facts(spark, tmp_path):
    """Also after late facts, and with a look-back that begins inside a day; untouched days are neither read nor written."""
    path, facts = str(tmp_path), []
    for batch, (first, days) in enumerate([(0, 4), (4, 4), (1, 1)]):
        facts.append(facts_of(spark, batch, 80, first, days))
        before = files(f"{path}/partials")
        usage_store.record_batch(facts[-1], path, batch)
        after = files(f"{path}/partials")
    untouched = [f for f in before if "day=2024-01-11" not in f]
    assert len(untouched) >= 6 and all(after[f] == before[f] for f in untouched)
    every, keys = facts[0].union(facts[1]).union(facts[2]), keys_of(spark)
    recorded = usage_store.read_facts(spark, path, FACTS)
    for as_of, days in ((dt.datetime(2024, 1, 18), 30), (dt.datetime(2024, 1, 18, 13, 7), 5), (dt.datetime(2024, 1, 17, 23, 59, 59), 1)):
        want = us.usage_stats(every, keys, F.lit(as_of), days)
        got = usage_store.usage_stats_stored(spark, path, recorded, keys, as_of, days)
        assert plain(got) == plain(want) and want.count() > 12
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(day#") >= 2 and "PartitionFilters: []" not in plan
    plan = usage_store.read_facts(spark, path, FACTS, [dt.date(2024, 1, 11)])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ = 2024-01-11", plan)


def test_last_use_touches_the_buckets_of_its_keys_alone(spark, tmp_path):
    path = str(tmp_path)
    every = facts_of(spark, 4, 100)
    usage_store.merge_last_used(every, path, buckets=8)
    before = files(path)
    late = spark.createDataFrame([("k1", "x", 200, 1, START - dt.timedelta(days=9)), (None, "x", 200, 1, START)], FACTS)
    touched = usage_store.merge_last_used(late, path, buckets=8)
    assert touched == [r[0] for r in late.filter("api_key_id = 'k1'").select(bucket_of("api_key_id", 8)).collect()]
    after = files(path)
    assert any(f"bucket={touched[0]}/" not in f for f in before) and all(after[f] == before[f] for f in before if f"bucket={touched[0]}/" not in f)
    assert plain(usage_store.read_last_used(spark, path, every)) == plain(us.last_used_per_key(every))  # an older use changes nothing
    assert usage_store.merge_last_used(every.filter("false"), path) == []


def test_a_stream_of_facts(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    parts = [facts_of(spark, 10 + i, 30, i, 3) for i in range(3)]
    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(source)
    seen = []
    for _ in range(2):
        stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(source)
        usage_store.record_usage(stream, path, str(tmp_path / "checkpoint"), after=lambda facts, batch: seen.append(batch)).awaitTermination()
        parts[2].coalesce(1).write.mode("append").parquet(source)
    assert seen == [0, 1, 2]
    every = parts[0].union(parts[1]).union(parts[2])
    assert plain(usage_store.read_facts(spark, path, FACTS).drop("day", "batch")) == plain(every)
    assert plain(usage_store.read_last_used(spark, path, every)) == plain(us.last_used_per_key(every))


# ── incidents ───────────────────────────────────────────────────────


def events_of(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_time", F.col("ts").cast("timestamp"))
    return sample_logs(events, "event_time").withColumn("incident_id", F.concat(F.lit("I"), (F.col("log_id") % 7).cast("string")))


def summaries(df):
    return sorted(map(repr, df.withColumn("category_breakdown", F.array_sort(F.map_entries("category_breakdown"))).collect()))


def from_table(logs):
    """The batch operator, lines ordered by time and id."""
    order = F.row_number().over(inc.Window.orderBy("event_time", "log_id"))
    return summaries(inc.incident_summary(logs.withColumn("seq", order)))


def test_summaries_of_late_and_repeated_files(spark, tmp_path):
    """Files out of order, one of them twice under another name: the same as the table at the end, and after each file."""
    logs = events_of(spark).persist()
    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    parts = [logs.filter(F.col("log_id") % 3 == k) for k in (2, 0, 1)] + [logs.filter(F.col("log_id") % 3 == 0)]
    seen = None
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(logs.schema).parquet(source)
        incident_store.stream_incident_summary(stream, path, str(tmp_path / "checkpoint"), late="60 days", buckets=4).awaitTermination()
        seen = part if seen is None else seen.union(part).distinct()
        assert summaries(incident_store.read_summaries(spark, path)) == from_table(seen)
    assert len(from_table(logs)) == 7
    logs.unpersist()


def test_a_repeated_batch_counts_once(spark, tmp_path):
    """A batch that failed after it had merged some of its buckets is merged into the others alone."""
    logs = assess_logs(events_of(spark)).persist()
    path = str(tmp_path)
    first, second = logs.filter("log_id % 2 = 0"), logs.filter("log_id % 2 = 1")
    incident_store.update_summaries(first, path, 0, buckets=4)
    some = second.filter(bucket_of("incident_id", 4) < 2)
    assert 0 < some.count() < second.count()
    incident_store.merge_records(some, path, 1, buckets=4)  # as far as it came
    for _ in range(2):
        incident_store.update_summaries(second, path, 1, buckets=4)
    assert summaries(incident_store.read_summaries(spark, path)) == from_table(events_of(spark))
    records = spark.read.parquet(f"{path}/records")
    assert records.groupBy("incident_id", "rank").count().filter("count > 1").isEmpty()
    logs.unpersist()


def test_incidents_expire(spark, tmp_path):
    def lines(day, incident):
        rows = [(10 * day + i, incident, START + dt.timedelta(days=day), "ERROR ECONNREFUSED 10.0.0.1:5432") for i in range(3)]
        return assess_logs(spark.createDataFrame(rows, "log_id long, incident_id string, event_time timestamp, raw_log string"))

    path = str(tmp_path)
    for batch, (day, incident) in enumerate([(0, "old"), (20, "new"), (21, "new")]):
        incident_store.update_summaries(lines(day, incident), path, batch, buckets=1, expiry=dt.timedelta(days=7))
    assert {r["incident_id"] for r in spark.read.parquet(f"{path}/records").collect()} == {"new"}
    got = {r["incident_id"]: r["total_logs_analyzed"] for r in incident_store.read_summaries(spark, path).collect()}
    assert got == {"old": 3, "new": 6}


def test_lines_shrink_before_they_are_merged(spark):
    """Of a hot incident, a task sends one record per rule."""
    plan = incident_store._records(assess_logs(events_of(spark)), 4)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan[plan.index("Exchange hashpartitioning(incident_id"):] and plan.count("Exchange hashpartitioning(incident_id") == 1


@pytest.mark.parametrize("n", [0])
def test_nothing_arrives(spark, tmp_path, n):
    none = assess_logs(events_of(spark).limit(n))
    incident_store.update_summaries(none, str(tmp_path), 0)
    assert stored_table(spark, f"{tmp_path}/records", incident_store.RECORDS).count() == 0
