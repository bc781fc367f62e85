"""One summary per incident, however many lines it has.

Lines are first counted per (incident, rule): a partial aggregate that shrinks
any incident, hot ones too, to at most one row per rule before it is
shuffled.  All order-dependent parts (first-seen order) follow from the smallest
``seq`` per rule, so no list of lines is ever built.  The time line, which has
one entry per line, is a table of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlore.catalogue import BUILTIN_RULES, Rule
from faultlore.functions import severity as sv
from faultlore.functions.metadata import extract_timestamp
from faultlore.functions.slices import SLICE, Slices
from faultlore.functions.text import constant, trimmed
from faultlore.operators.explaining import (
    UNKNOWN, UNKNOWN_FIXES, UNKNOWN_ROOT_CAUSE, assess_logs, summary_text)

# Fixed values from here on.

MANY_HIGH, MORE_HIGH, MANY_HIGH_BOOST = 3, 5, 5
MANY_CRITICAL, MANY_CRITICAL_BOOST = 2, 10
TOP_FIXES = 10
TITLE_SUMMARY_LENGTH = 80
TIMELINE_SUMMARY_LENGTH = 150
EMPTY_TITLE = "No Logs Provided"
EMPTY_SUMMARY = "No log entries were provided for incident analysis."
DASH = " — "
TITLE_HEAD = " Incident" + DASH
TITLE_UNKNOWN = "Unrecognized Errors Detected"
TITLE_SEVERAL = " issue types detected across "
REASON = "Aggregate of %d logs. Max score: %d. High-severity count: %d. Critical count: %d."
ANALYZED = "Analyzed %d log entries. Overall severity: %s (score: %d/100)."
AFFECTED = "Affected systems: "
CRITICAL_LINES = "%d critical-severity log(s) require immediate attention."
HIGH_LINES = "%d high-severity log(s) detected."
CORRELATED = "Correlations found: "


class Correlation(NamedTuple):
    """Holds if each group has a category or rule id that occurs in the incident."""

    groups: tuple[tuple[str, ...], ...]
    text: str


CORRELATIONS = (
    Correlation(
        (("database",), ("timeout", "API_TIMEOUT")),
        "Database issues detected alongside API timeouts — "
        "the database may be the root cause of slow API responses"),
    Correlation(
        (("memory",), ("process",)),
        "Memory issues detected alongside process crashes — "
        "out-of-memory condition likely caused the crash"),
    Correlation(
        (("authentication",), ("security",)),
        "Authentication failures alongside security alerts — potential coordinated attack"),
    Correlation(
        (("dns",), ("network",)),
        "DNS resolution failures detected alongside network errors — "
        "DNS may be the initial failure point"),
    Correlation(
        (("disk",), ("database",)),
        "Disk space issues alongside database errors — "
        "disk full condition may have caused database failure"),
    Correlation(
        (("configuration",), ("application",)),
        "Configuration errors alongside application failures — "
        "misconfiguration is a likely root cause"),
)


# ── aggregate severity ──────────────────────────────────────────────


def severity_counts() -> list[Column]:
    """Aggregates over lines from which the severity of any group follows."""
    score = F.col("severity_score")
    return [
        F.count("*").alias("total_logs"),
        F.max(score).alias("max_score"),
        F.count_if(score >= sv.HIGH_SCORE).alias("high_scores"),
        F.count_if(score >= sv.CRITICAL_SCORE).alias("critical_scores"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_logs"),
        F.count_if(F.col("severity") == "HIGH").alias("high_logs"),
    ]


def aggregate_score(max_score: Column, high: Column, critical: Column) -> Column:
    def boosted(score: Column, condition: Column, by: int) -> Column:
        return F.least(score + F.when(condition, by).otherwise(0), F.lit(100))

    score = boosted(max_score, high >= MANY_HIGH, MANY_HIGH_BOOST)
    score = boosted(score, high >= MORE_HIGH, MANY_HIGH_BOOST)
    return boosted(score, critical >= MANY_CRITICAL, MANY_CRITICAL_BOOST)


def with_aggregate_severity(counted: DataFrame) -> DataFrame:
    """Adds the overall ``severity``, ``severity_score`` and ``severity_reason``."""
    return (counted
            .withColumn("severity_score", aggregate_score(
                F.col("max_score"), F.col("high_scores"), F.col("critical_scores")))
            .withColumns({
                "severity": sv.score_to_level(F.col("severity_score")),
                "severity_reason": F.format_string(
                    REASON, "total_logs", "max_score", "high_scores", "critical_scores"),
            }))


def aggregate_severity(assessed: DataFrame, *keys: str) -> DataFrame:
    return with_aggregate_severity(assessed.groupBy(*keys).agg(*severity_counts()))


def category_breakdown(assessed: DataFrame, *keys: str) -> DataFrame:
    """Lines per category, with the first ``seq`` of each."""
    return assessed.groupBy(*keys, "category").agg(
        F.count("*").alias("logs"), F.min("seq").alias("first_seq"))


# ── incident summary ────────────────────────────────────────────────


def _by_rank(values: list, ddl: str, rank: Column) -> Column:
    """Value of a rule; the first value stands for rank 0, no rule."""
    return F.element_at(constant(values, f"array<{ddl}>"), rank + 1)


ASSESSED_COLUMNS = (
    "incident_id", "seq", "timestamp", "log_level", "rank", "category", "severity", "severity_score")


def _assessed(logs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Lines as they are if they have been assessed, and written, before."""
    return logs if set(ASSESSED_COLUMNS) <= set(logs.columns) else assess_logs(logs, rules)


#: Counts that add up over parts of an incident; the highest score is taken instead.
SUMMED = ("total_logs", "high_scores", "critical_scores", "critical_logs", "high_logs")


def incident_rule_counts(assessed: DataFrame, first: Column | None = None, *more: Column) -> DataFrame:
    """One record per incident and rule; ``first`` orders lines, ``seq`` if not given.  ``more``: aggregates of that order, as ``seq``."""
    lines = assessed.filter(F.col("incident_id").isNotNull()).select(
        "incident_id", (F.col("seq") if first is None else first).alias("seq"), "rank", "severity_score", "severity")
    return lines.groupBy("incident_id", "rank").agg(*severity_counts(), F.min("seq").alias("first_seq"), *more)


def incident_rules_of(per_rule: DataFrame) -> DataFrame:
    """``incident_rules`` from records per incident and rule."""
    return per_rule.groupBy("incident_id").agg(
        F.max("max_score").alias("max_score"),
        *[F.sum(c).alias(c) for c in SUMMED],
        F.array_sort(F.collect_list(F.struct(
            "first_seq", "rank", F.col("total_logs").alias("logs")))).alias("by_rule"))


def incident_rules(logs: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Per incident, its counts and ``by_rule``: the rules seen, first seen first.

    ``by_rule`` has at most one element per rule of the catalogue.
    """
    return incident_rules_of(incident_rule_counts(_assessed(logs, rules)))


def detect_correlations(signs: Column, correlations: Sequence[Correlation] = CORRELATIONS) -> Column:
    """Texts of the correlations that hold, given the categories and rule ids seen."""
    texts = []
    for correlation in correlations:
        holds = F.lit(True)
        for group in correlation.groups:
            holds = holds & F.arrays_overlap(signs, F.array(*map(F.lit, group)))
        texts.append(F.when(holds, F.lit(correlation.text)))
    return F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")


def category_label(category: Column) -> Column:
    return F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))


def incident_title(severity: Column, patterns: Column, first_summary: Column,
                   top_category: Column) -> Column:
    head = F.concat(severity, F.lit(TITLE_HEAD))
    return (F.when(patterns == 0, F.concat(head, F.lit(TITLE_UNKNOWN)))
            .when(patterns == 1, F.concat(head, F.substring(first_summary, 1, TITLE_SUMMARY_LENGTH)))
            .otherwise(F.concat(head, patterns.cast("string"),
                                F.lit(TITLE_SEVERAL),
                                category_label(top_category))))


def append_context(title: Column, context: Column) -> Column:
    return F.when(F.nullif(context, F.lit("")).isNotNull(),
                  F.concat(title, F.lit(DASH), context)).otherwise(title)


def incident_summary_text() -> Column:
    systems = F.array_join(F.transform(
        "affected_systems", lambda c: F.replace(c, F.lit("_"), F.lit(" "))), ", ")
    return F.concat_ws(
        " ",
        F.format_string(ANALYZED, "total_logs", "severity", "severity_score"),
        F.when(F.size("affected_systems") > 0,
               F.concat(F.lit(AFFECTED), systems, F.lit("."))),
        F.when(F.col("critical_logs") > 0, F.format_string(CRITICAL_LINES, "critical_logs")),
        F.when(F.col("high_logs") > 0,
               F.format_string(HIGH_LINES, "high_logs")),
        F.when(F.size("correlations") > 0, F.concat(
            F.lit(CORRELATED), F.array_join("correlations", "; "), F.lit("."))))


def incident_facts(logs: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES,
                   correlations: Sequence[Correlation] = CORRELATIONS) -> DataFrame:
    """What a summary says of each incident: counts, ``severity``, ``known`` (ranks of
    the rules seen), ``breakdown``, ``top_category``, ``affected_systems``,
    ``root_cause_chain``, ``recommended_actions`` and ``correlations``."""
    return incident_facts_of(incident_rules(logs, rules), rules, correlations)


def incident_facts_of(rules_seen: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES,
                      correlations: Sequence[Correlation] = CORRELATIONS) -> DataFrame:
    """``incident_facts`` from what ``incident_rules`` tells."""
    ids = [UNKNOWN] + [r.rule_id for r in rules]
    categories = [UNKNOWN] + [r.category for r in rules]
    causes = [UNKNOWN_ROOT_CAUSE] + [r.root_cause for r in rules]
    fixes = [list(UNKNOWN_FIXES)] + [list(r.recommended_fixes) for r in rules]

    seen = with_aggregate_severity(rules_seen)
    seen = seen.withColumns({
        "by_rule": F.transform("by_rule", lambda r: F.struct(
            r["rank"].alias("rank"), r["logs"].alias("logs"),
            _by_rank(categories, "string", r["rank"]).alias("category"))),
    })
    seen = seen.withColumns({
        "categories": F.array_distinct(F.transform("by_rule", lambda r: r["category"])),
        "known": F.transform(F.filter("by_rule", lambda r: r["rank"] > 0), lambda r: r["rank"]),
    })
    return seen.withColumns({
        "breakdown": F.transform("categories", lambda c, i: F.struct(
            F.aggregate(F.filter("by_rule", lambda r: r["category"] == c), F.lit(0).cast("bigint"),
                        lambda total, r: total + r["logs"]).alias("logs"),
            (-i).alias("order"), c.alias("category"))),
        "affected_systems": F.filter("categories", lambda c: c != UNKNOWN),
        "root_cause_chain": F.array_distinct(
            F.transform("known", lambda r: _by_rank(causes, "string", r))),
        "recommended_actions": F.slice(F.array_distinct(F.flatten(F.transform(
            "by_rule", lambda r: _by_rank(fixes, "array<string>", r["rank"])))), 1, TOP_FIXES),
        "correlations": detect_correlations(
            F.concat("categories", F.transform("known", lambda r: _by_rank(ids, "string", r))),
            correlations),
    }).withColumn("top_category", F.array_max("breakdown")["category"])


def incident_summary_of(seen: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Summary rows from what ``incident_facts`` tells."""
    summaries = [""] + [r.summary for r in rules]
    first_summary = F.coalesce(_by_rank(
        summaries, "string", F.try_element_at("known", F.lit(1))), F.lit(""))
    return seen.select(
        "incident_id",
        incident_title(F.col("severity"), F.size("known"), first_summary, F.col("top_category")).alias("title"),
        incident_summary_text().alias("summary"),
        "severity", "severity_score", "severity_reason",
        "root_cause_chain", "affected_systems", "recommended_actions",
        F.col("total_logs").alias("total_logs_analyzed"),
        F.map_from_entries(F.transform("breakdown", lambda b: F.struct(
            b["category"].alias("key"), b["logs"].alias("value")))).alias("category_breakdown"),
        "correlations")


def incident_summary(logs: DataFrame, incidents: DataFrame | None = None,
                     rules: Sequence[Rule] = BUILTIN_RULES,
                     correlations: Sequence[Correlation] = CORRELATIONS) -> DataFrame:
    """One summary row per incident.

    ``logs`` has ``incident_id, seq, raw_log``, or the columns of a table that
    ``plans.jobs`` assessed before; ``seq`` is unique per incident and gives the
    input order.  ``incidents`` (``incident_id, context``) adds context
    to titles and yields the empty summary for incidents without any line.
    """
    summary = incident_summary_of(incident_facts(logs, rules, correlations), rules)
    if incidents is None:
        return summary

    empty_list = F.array().cast("array<string>")
    empty = {
        "title": F.lit(EMPTY_TITLE), "summary": F.lit(EMPTY_SUMMARY), "severity": F.lit("LOW"),
        "severity_score": F.lit(0), "severity_reason": F.lit("No logs to analyze"),
        "root_cause_chain": empty_list, "affected_systems": empty_list,
        "recommended_actions": empty_list, "total_logs_analyzed": F.lit(0).cast("bigint"),
        "category_breakdown": F.create_map().cast("map<string,bigint>"),
        "correlations": empty_list,
    }
    joined = incidents.select("incident_id", "context").join(summary, "incident_id", "left")
    filled = joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in empty.items()})
    return (filled.withColumn("title", append_context(F.col("title"), F.col("context")))
            .drop("context"))


# ── time line ───────────────────────────────────────────────────────


def incident_timeline(logs: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES, slices: int | None = None,
                      collation: str | None = None) -> DataFrame:
    """One row per line with its ``position`` in the incident's time line:
    by time stamp text, lines without one last, ties by ``seq``.

    Raw lines are sorted once, before they are explained.  An incident with more than
    its share of all lines is cut into ranges of this order, which are sorted by
    tasks of their own; a line's position is its place in the range after the
    lines in the ranges before, which are counted from stamps alone.

    Stamps are ordered by code point, or by ``collation``, such as ``UNICODE``.  ``seq``
    should be filled and unique per incident: lines without it come last among equal
    stamps, ordered by a hash of their text or of what has been found in it.  Lines without an ``incident_id`` belong to
    no incident and are left out, as in the summary.
    """
    stamp = F.col("timestamp") if set(ASSESSED_COLUMNS) <= set(logs.columns) else extract_timestamp(trimmed(F.col("raw_log")))
    lines = logs.filter("incident_id IS NOT NULL").withColumn("_stamp", stamp)
    text = F.coalesce("_stamp", F.lit(""))
    tie = F.xxhash64(*([c for c in ("raw_log", "log_id") if c in logs.columns] or [c for c in ASSESSED_COLUMNS if c != "seq"]))
    order = [F.col("_stamp").isNull(), F.collate(text, collation) if collation else text,
             F.col("seq").isNull(), F.col("seq"), F.when(F.col("seq").isNull(), tie)]
    ranges = Slices(lines, "incident_id", order, slices)
    slim = ranges.cut_only(lines).groupBy("incident_id", SLICE).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("incident_id", SLICE).orderBy(*order))
    placed = ranges.with_carry(ranges.cut(lines).withColumn("_place", place), slim, _before=F.sum("_n"))
    placed = placed.withColumn("position", F.col("_place") + F.coalesce("_before", F.lit(0)))
    return _assessed(placed.drop("_stamp", "_place", "_before", SLICE), rules).select(
        "incident_id", "position", "seq", "timestamp",
        F.substring(summary_text(F.col("rank"), F.col("log_level"), rules), 1, TIMELINE_SUMMARY_LENGTH).alias("summary"),
        "severity", "category")


def incident_timeline_pages(timeline: DataFrame, page_size: int = 100) -> DataFrame:
    """The time line as arrays: one row per incident and page, pages from 0.

    Every line is on one page and no array is longer than ``page_size``, so an
    incident of any length is complete.
    """
    if page_size < 1:
        raise ValueError("page_size must be positive")
    page = F.floor((F.col("position") - 1) / F.lit(page_size)).alias("page")
    entry = F.struct("position", "timestamp", "summary", "severity", "category")
    return timeline.groupBy("incident_id", page).agg(F.array_sort(F.collect_list(entry)).alias("timeline"))
