"""Explain log lines: metadata, best rule, severity and advice per line.

Row-wise throughout, without join or shuffle, so the same function serves
batch tables and streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlore.catalogue import BUILTIN_RULES, Rule
from faultlore.functions import severity as sv
from faultlore.functions.metadata import override_source
from faultlore.functions.text import apart, constant
from faultlore.operators.matching import with_candidates
from faultlore.operators.parsing import METADATA_COLUMNS, metadata_map, parse_log_line

# What is said about a line no rule matches.
UNKNOWN = "unknown"
UNKNOWN_ROOT_CAUSE = "Unable to determine root cause — this log does not match any known pattern."
UNKNOWN_CAUSES = (
    "New or uncommon error not yet in the knowledge base",
    "Custom application-specific log format",
    "Informational log with no actionable issue",
)
UNKNOWN_FIXES = (
    "Review the log message manually for context",
    "Check application documentation for this specific message",
    "If this is a recurring issue, consider adding a custom pattern to the knowledge base",
)
UNKNOWN_SUMMARY = "This log entry could not be matched to a known pattern in the knowledge base."
UNKNOWN_SUMMARY_ERROR = (
    "An error-level log entry was detected but does not match any known pattern. "
    "Manual review is recommended.")
UNKNOWN_SUMMARY_WARNING = (
    "A warning-level log entry was detected but does not match any known pattern. "
    "It may indicate a non-critical issue.")
UNKNOWN_SUMMARY_OTHER = (
    'An informational log entry was detected with log level "%s". '
    "No specific issue pattern was matched.")
ERROR_WORDS = ("ERROR", "ERR", "FATAL", "CRIT", "CRITICAL", "EMERG")
WARNING_WORDS = ("WARN", "WARNING")
ENGINE = "rule-based"

EXPLANATION_COLUMNS = (
    "raw_log", "pattern_id", "summary", "category", "severity", "severity_score", "root_cause",
    "possible_causes", "recommended_fixes", "metadata", "timestamp", "source", "confidence",
    "engine",
)


def best_match(logs: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Adds ``rank`` (0 if no rule matches), ``pattern_id``, ``category`` and ``confidence``."""
    ids = constant([r.rule_id for r in rules], "array<string>")
    categories = constant([r.category for r in rules], "array<string>")
    best, rank = F.try_element_at(F.col("_candidates"), F.lit(1)), F.col("rank")
    kept = logs.columns

    def of_rule(values: Column) -> Column:
        return F.when(rank > 0, F.try_element_at(values, rank)).otherwise(F.lit(UNKNOWN))

    return (with_candidates(logs, rules, "_candidates")
            .select(*kept, F.coalesce(-best["neg_rank"], F.lit(0)).alias("rank"),
                    F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"))
            .select("*", of_rule(ids).alias("pattern_id"), of_rule(categories).alias("category")))


def _rule_severity(rules: Sequence[Rule]) -> Column:
    return F.try_element_at(constant([r.severity for r in rules], "array<string>"), F.nullif("rank", F.lit(0)))


def severity_steps(matched: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Adds the steps of the score of lines a rule matches, each from the one before:
    ``rule_score``, ``modifier`` (score, reason), ``modified``, ``blended``,
    ``in_context`` and ``repeated``."""
    line = F.col("raw_log")
    return (matched
            .select("*", sv.base_score(_rule_severity(rules)).alias("rule_score"),
                    sv.modifier_applied(rules).alias("modifier"))
            .select("*", apart(F.coalesce("modifier.score", "rule_score")).alias("modified"))
            .select("*", sv.level_blend(F.col("modified"), F.col("log_level")).alias("blended"))
            .select("*", sv.context_boost(F.col("blended"), line).alias("in_context"))
            .select("*", apart(sv.repetition_boost(F.col("in_context"), line)).alias("repeated")))


def calculate_severity(matched: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Adds ``severity``, ``severity_score``, ``severity_reason`` from ``raw_log``,
    ``rank`` and ``log_level``."""
    level, rule_id = F.col("log_level"), F.col("pattern_id")
    known, score, kept = F.col("rank") > 0, F.col("severity_score"), matched.columns
    return (severity_steps(matched, rules)
            .select(*kept, "modifier", F.when(known, sv.severity_clamp(F.col("repeated")))
                    .otherwise(sv.unknown_score(level)).cast("int").alias("severity_score"))
            .select(
                *kept, sv.score_to_level(score).alias("severity"), "severity_score",
                F.when(known, F.coalesce(
                    F.col("modifier.reason"),
                    F.concat(F.lit("Base severity: "), _rule_severity(rules),
                             F.lit(" (pattern: "), rule_id, F.lit(")"))))
                .otherwise(F.concat(
                    F.lit("No known pattern matched. Severity derived from log level: "),
                    F.coalesce(level, F.lit("unknown")))).alias("severity_reason")))


def unknown_summary(level: Column) -> Column:
    before, after = UNKNOWN_SUMMARY_OTHER.split("%s")
    return (F.when(level.isNull(), F.lit(UNKNOWN_SUMMARY))
            .when(level.isin(*ERROR_WORDS), F.lit(UNKNOWN_SUMMARY_ERROR))
            .when(level.isin(*WARNING_WORDS), F.lit(UNKNOWN_SUMMARY_WARNING))
            .otherwise(F.concat(F.lit(before), level, F.lit(after))))


def _advice(rank: Column, values: list, ddl: str, unknown: Column) -> Column:
    return F.when(rank > 0, F.try_element_at(constant(values, f"array<{ddl}>"), rank)).otherwise(unknown)


def summary_text(rank: Column, level: Column, rules: Sequence[Rule]) -> Column:
    return _advice(rank, [r.summary for r in rules], "string", unknown_summary(level))


def root_cause_text(rank: Column, rules: Sequence[Rule]) -> Column:
    return _advice(rank, [r.root_cause for r in rules], "string", F.lit(UNKNOWN_ROOT_CAUSE))


def causes_list(rank: Column, rules: Sequence[Rule]) -> Column:
    return _advice(rank, [list(r.possible_causes) for r in rules], "array<string>",
                   F.array(*map(F.lit, UNKNOWN_CAUSES)))


def fixes_list(rank: Column, rules: Sequence[Rule]) -> Column:
    return _advice(rank, [list(r.recommended_fixes) for r in rules], "array<string>",
                   F.array(*map(F.lit, UNKNOWN_FIXES)))


def attach_explanation(scored: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Adds summary, root cause, causes, fixes and engine of the best rule."""
    rank, level = F.col("rank"), F.col("log_level")
    return scored.withColumns({
        "summary": summary_text(rank, level, rules),
        "root_cause": root_cause_text(rank, rules),
        "possible_causes": causes_list(rank, rules),
        "recommended_fixes": fixes_list(rank, rules),
        "engine": F.lit(ENGINE),
    })


def assess_logs(logs: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Metadata, best rule and severity, without the advice texts."""
    return calculate_severity(best_match(parse_log_line(logs), rules), rules)


def explain_logs(logs: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """One explanation per log line.

    ``logs`` needs ``raw_log`` and may have ``source``; its other columns are kept.
    """
    kept = [c for c in logs.columns if c not in EXPLANATION_COLUMNS]
    given = F.col("_given") if "source" in logs.columns else F.lit(None).cast("string")
    if "source" in logs.columns:
        logs = logs.withColumnRenamed("source", "_given")
    explained = attach_explanation(assess_logs(logs, rules), rules)
    return (explained
            .withColumn("source", override_source(F.col("extracted_source"), given))
            .withColumn("metadata", metadata_map(F.col("rank") > 0))
            .select(*kept, *EXPLANATION_COLUMNS))


def known_only(explained: DataFrame) -> DataFrame:
    return explained.filter(F.col("pattern_id") != UNKNOWN)
