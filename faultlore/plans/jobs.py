"""Whole jobs: read tables, run operators, write tables.

Lines are matched once; the result is written, and every report reads that
table.  So a lost executor costs the tasks it ran, not the matching of all lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from faultlore.catalogue import BUILTIN_RULES, Rule
from faultlore.functions.severity import BASE_SCORES
from faultlore.operators import incidents as inc
from faultlore.operators import usage as us
from faultlore.operators.explaining import assess_logs, explain_logs
from faultlore.operators.parsing import reject_empty_logs


def explain_table(logs: DataFrame, path: str, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Explain all lines into a Parquet table, by severity so that reports on the
    grave ones read only those.  A task keeps a file open for each severity, so the
    wide rows are written as they come, unsorted."""
    spark, name = logs.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(len(BASE_SCORES) + 1))
    try:
        explain_logs(reject_empty_logs(logs), rules).write.partitionBy("severity").parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(path)


def incident_report(logs: DataFrame, path: str, incidents: DataFrame | None = None,
                    rules: Sequence[Rule] = BUILTIN_RULES) -> tuple[DataFrame, DataFrame]:
    """Summaries and time lines under ``path``; returns both tables."""
    spark = logs.sparkSession
    assessed = assess_logs(reject_empty_logs(logs), rules).select(*inc.ASSESSED_COLUMNS)
    assessed.write.parquet(f"{path}/assessed")
    assessed = spark.read.parquet(f"{path}/assessed")
    inc.incident_summary(assessed, incidents, rules).write.parquet(f"{path}/summary")
    (inc.incident_timeline(assessed, rules)
     .repartitionByRange("incident_id", "position")
     .sortWithinPartitions("incident_id", "position")
     .write.parquet(f"{path}/timeline"))
    return spark.read.parquet(f"{path}/summary"), spark.read.parquet(f"{path}/timeline")


def usage_report(usage: DataFrame, keys: DataFrame, path: str, as_of: Column,
                 days: str | int | None = None) -> DataFrame:
    """The usage report of every owner as a Parquet table."""
    report = us.usage_stats(usage, keys, as_of, us.days_limit(days))
    report.write.parquet(path)
    return usage.sparkSession.read.parquet(path)
