import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from checks.registry import REGISTRY

SF = "/root/testdata/sf0.001"
FAST = ["parse_log_line", "match_rules", "explain_logs", "incident_summary", "incident_timeline", "usage_stats",
        "attribute_requests", "keyword_candidates", "read_raw_logs_lines", "last_used_per_key"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    """All but those of the llm subpackage, most of which SQL cannot express."""
    assert set(REGISTRY) <= set(entry.queries()) and set(REGISTRY) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(REGISTRY) > 80


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "title" in df.columns


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    result = con.sql(entry.oracle_sql()[name])
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(result.columns)
    assert mine and mine == rows_of(result.columns, result.fetchall())
