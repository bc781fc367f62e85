import datetime as dt

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from faultlore.operators import explaining as ex
from faultlore.operators import incidents as inc
from faultlore.plans import jobs
from checks.derived import derived_keys, derived_usage
from checks.sample_logs import sample_logs

SF = "/root/testdata/sf0.001"


def rows(df):
    columns = sorted(df.columns)
    if "category_breakdown" in columns:
        df = df.withColumn("category_breakdown", F.array_sort(F.map_entries("category_breakdown")))
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_incident_report_equals_the_operators(spark, tmp_path):
    logs = sample_logs(spark.read.parquet(f"{SF}/events.parquet"))
    summary, timeline = jobs.incident_report(logs, str(tmp_path))
    assert rows(summary) == rows(inc.incident_summary(logs))
    assert rows(timeline) == rows(inc.incident_timeline(logs))


def test_explain_table(spark, tmp_path):
    logs = sample_logs(spark.read.parquet(f"{SF}/events.parquet"))
    written = jobs.explain_table(logs, str(tmp_path / "t"))
    expected = ex.explain_logs(logs).groupBy("severity", "pattern_id").count()
    assert rows(written.groupBy("severity", "pattern_id").count()) == rows(expected)


def test_explain_table_is_written_without_a_sort(spark, tmp_path, monkeypatch):
    """Tasks keep a file open for each severity; the setting is as before afterwards."""
    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a: (seen.append(int(spark.conf.get(name))), parquet(self, *a))[1])
    logs = sample_logs(spark.read.parquet(f"{SF}/events.parquet")).limit(50)
    before = spark.conf.get(name)
    severities = jobs.explain_table(logs, str(tmp_path / "t")).select("severity").distinct().count()
    assert len(seen) == 1 and seen[0] > severities > 1 and spark.conf.get(name) == before


def test_usage_report(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    report = jobs.usage_report(derived_usage(events), derived_keys(events), str(tmp_path / "u"),
                               F.lit(dt.datetime(2024, 1, 31)), "45")
    total = report.filter("part = 'total_requests'").agg(F.sum("value")).first()[0]
    assert total == events.count()
