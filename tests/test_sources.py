import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from faultlore.operators import explaining as ex
from checks.folders import shared_folder
from faultlore.sources import tables


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("ERROR out of memory\n\nWARN hm\n")
    logs = tables.read_raw_logs(spark, str(tmp_path), source="host-1")
    assert logs.columns == ["log_id", "seq", "raw_log", "source"]
    assert [(r["raw_log"], r["source"]) for r in logs.orderBy("seq").collect()] == [
        ("ERROR out of memory", "host-1"), ("", "host-1"), ("WARN hm", "host-1")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in [
        {"message": "ENOSPC", "incident_id": "i", "seq": 5}, {"message": "hm", "log_id": 9}]))
    logs = tables.read_raw_logs(spark, str(tmp_path), fmt="json", line_column="message")
    got = {r["raw_log"]: r for r in logs.collect()}
    assert got["ENOSPC"]["seq"] == 5 and got["ENOSPC"]["incident_id"] == "i"
    assert got["hm"]["log_id"] == got["hm"]["seq"] == 9


def test_parquet_round_trip_and_json_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "SIGABRT", None)], tables.RAW_LOGS_DDL.replace("incident_id string, ", ""))
    df.write.parquet(str(tmp_path / "logs"))
    logs = tables.read_raw_logs(spark, str(tmp_path / "logs"), fmt="parquet")
    explained = ex.explain_logs(logs)
    tables.write_explanations(explained, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["pattern_id"] == "SYS_PROCESS_CRASH"
    text = json.loads(tables.explanations_json(explained).first()[0])
    assert text["severity"] == "CRITICAL" and text["metadata"] == {}


def test_split_and_explode(spark):
    df = spark.createDataFrame([(1, "a\nb\n", ["x", "y"])], "k int, text string, logs array<string>")
    assert [tuple(r) for r in tables.split_lines(df, "text", "k").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "")]
    assert [tuple(r) for r in tables.explode_batch(df, "logs", "k").collect()] == [(1, 0, "x"), (1, 1, "y")]


def test_append_usage_by_day(spark, tmp_path):
    path = str(tmp_path / "usage")
    schema = "api_key_id string, endpoint string, status_code int, response_time_ms int, created_at timestamp"
    for day in (1, 2):
        tables.append_usage(spark.createDataFrame(
            [("k", "A", 200, 1, dt.datetime(2024, 1, day))], schema), path)
    got = tables.read_usage(spark, path, since=F.lit(dt.datetime(2024, 1, 1)), newest_first=True)
    assert [r["created_at"].day for r in got.collect()] == [2, 1]
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in \
        got._jdf.queryExecution().executedPlan().toString()


def test_usage_is_sorted_only_on_demand(spark, tmp_path):
    path = str(tmp_path / "usage")
    spark.range(3).selectExpr("id", "timestamp_seconds(id) AS created_at").write.parquet(path)
    assert "Sort" not in tables.read_usage(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_ids_follow_files_and_lines(spark, tmp_path):
    for name, n in (("a.log", 3), ("b.log", 5000), ("c.log", 1)):
        (tmp_path / name).write_text("".join(f"{name}:{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = sorted((r["log_id"], r["raw_log"]) for r in tables.read_raw_logs(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [t for _, t in got] == [f"{f}:{i}" for f, n in (("a.log", 3), ("b.log", 5000), ("c.log", 1)) for i in range(n)]
    assert [i for i, _ in got] == list(range(5004))


def test_given_ids_are_never_mixed(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"log_id": 7, "raw_log": "a"}\n{"raw_log": "b"}\n')
    got = {r["raw_log"]: r["log_id"] for r in tables.read_raw_logs(spark, str(tmp_path), fmt="json").collect()}
    assert got == {"a": 7, "b": None}


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_cluster_without_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        shared_folder(Session())
