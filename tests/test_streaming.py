import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from faultlore.functions.slices import SLICE
from faultlore.operators import explaining as ex
from faultlore.operators import usage as us
from checks.sample_logs import sample_logs
from faultlore.streaming import operators as st
from faultlore.streaming.runs import partial_sessions, read_stream_table, run_available

SF = "/root/testdata/sf0.001"


def timed(events):
    return sample_logs(events.withColumn("event_time", F.col("ts").cast("timestamp")), "event_time")


def batch_logs(spark):
    return timed(spark.read.parquet(f"{SF}/events.parquet"))


def stream_logs(spark):
    return timed(read_stream_table(spark, SF, "events"))


def rows(df):
    return sorted(map(repr, df.withColumn("category_breakdown", F.array_sort(F.map_entries("category_breakdown")))
                      .collect()))


def closed(df, logs):
    latest = logs.agg(F.max("event_time")).first()[0]
    return df.filter(F.col("window_end") <= F.lit(latest - dt.timedelta(minutes=10)))


def test_stream_explains_like_batch(spark, tmp_path):
    streamed = run_available(st.stream_explain(stream_logs(spark)), str(tmp_path))
    batch = ex.explain_logs(batch_logs(spark))
    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, batch.collect()))


def test_windows(spark, tmp_path):
    streamed = run_available(st.stream_incident_windows(stream_logs(spark)), str(tmp_path))
    batch = closed(st.stream_incident_windows(batch_logs(spark), late=None), batch_logs(spark))
    got = rows(streamed)
    assert len(got) > 100 and got == rows(batch)


def test_sessions(spark, tmp_path):
    """The table is counted per second first, the stream is not; both agree."""
    with partial_sessions(spark):
        streamed = run_available(st.stream_incident_sessions(stream_logs(spark), gap_seconds=7200), str(tmp_path))
    batch = closed(st.stream_incident_sessions(batch_logs(spark), gap_seconds=7200, late=None), batch_logs(spark))
    got = rows(streamed)
    assert len(got) > 100 and got == rows(batch)


def sessions_by_force(rows, gap):
    out, last = [], {}
    for source, t in sorted(rows):
        if source not in last or t - last[source][1] >= dt.timedelta(seconds=gap):
            last[source] = [t, t, 0]
            out.append((source, last[source]))
        last[source][1], last[source][2] = t, last[source][2] + 1
    return sorted((source, a, b + dt.timedelta(seconds=gap), n) for source, (a, b, n) in out)


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_sessions_of_a_hot_source(spark, slices):
    """One source has nearly all lines; others have few, or none between ranges."""
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", start + dt.timedelta(microseconds=rng.randrange(600_000_000))) for _ in range(600)]
    rows += [("hot", start + dt.timedelta(seconds=700 + i)) for i in range(200)]  # one session over many ranges
    rows += [("hot", start + dt.timedelta(seconds=1000, microseconds=i)) for i in range(300)]  # within one second
    rows += [(f"s{rng.randrange(30)}", start + dt.timedelta(seconds=rng.randrange(2000))) for _ in range(80)]
    df = spark.createDataFrame([(t, "ERROR hm", source) for source, t in rows], "event_time timestamp, raw_log string, source string")
    for gap in (1, 3, 30):
        sessions = st.stream_incident_sessions(df, gap_seconds=gap, late=None, slices=slices)
        got = sorted((r["source"], r["window_start"], r["window_end"], r["total_logs"]) for r in sessions.collect())
        assert got == sessions_by_force(rows, gap)
    plan = sessions._jdf.queryExecution().optimizedPlan().toString()
    assert "session_window" not in plan
    assert "regexp" not in plan.lower()  # lines are assessed once, into a table
    keys = re.findall(r"windowspecdefinition\(source#\d+, (_\w+)#", plan)
    assert all(k == SLICE for k in keys) and keys or slices == 1


def test_streams_merge_sessions_before_the_shuffle(spark, tmp_path):
    """With the option a task's rows are merged on both sides of the exchange."""
    with partial_sessions(spark):
        query = (st.stream_incident_sessions(stream_logs(spark), gap_seconds=7200).writeStream.format("memory").queryName("merged")
                 .option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start())
        query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.count("MergingSessions") >= 2 and plan.rindex("MergingSessions") > plan.rindex("Exchange hashpartitioning")


def test_throttle_windows_of_a_stream(spark, tmp_path):
    """Requests in files out of order within the allowed lateness: the windows of the table, as far as they have ended."""
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [("busy", start + dt.timedelta(microseconds=rng.randrange(400_000_000))) for _ in range(700)]
    rows += [(f"c{rng.randrange(9)}", start + dt.timedelta(seconds=rng.randrange(500))) for _ in range(300)]
    rows += [("edge", start + dt.timedelta(seconds=60 * k, microseconds=d)) for k in range(6) for d in (0, 1, 59_999_999)]
    rows += [(None, start), ("none", None), ("last", start + dt.timedelta(seconds=700))]
    kind = "client string, created_at timestamp"
    whole = spark.createDataFrame(rows, kind)
    source = str(tmp_path / "in")
    files = [[] for _ in range(5)]
    for row in rows:  # some of the last half minute of a file come with the next
        at = 0 if row[1] is None else (row[1] - start).total_seconds()
        files[int(at // 200) + (at % 200 > 170 and rng.random() < 0.5)].append(row)
    for part in files[:4]:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    got = run_available(st.stream_throttle_windows(stream, late="60 seconds"), str(tmp_path / "out"))
    ends = start + dt.timedelta(seconds=700 - 60 - 60)
    want = us.throttle_windows(whole).filter(F.col("window_start") <= F.lit(ends))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.filter("client = 'busy'").count() >= 5 and got.filter("client = 'edge'").count() == 6
