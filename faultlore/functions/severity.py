"""Severity scores and levels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlore.catalogue import Rule
from faultlore.functions.regexes import spark_regex, sql_text
from faultlore.functions.text import WHITESPACE, constant, contains_any

# Fixed values from here on.

BASE_SCORES = {"LOW": 15, "MEDIUM": 40, "HIGH": 70, "CRITICAL": 90}
THRESHOLDS = (("CRITICAL", 80), ("HIGH", 55), ("MEDIUM", 30))
HIGH_SCORE = 55
CRITICAL_SCORE = 80

LEVEL_SEVERITY = {
    "CRITICAL": ("EMERG", "EMERGENCY", "FATAL", "CRIT", "CRITICAL"),
    "HIGH": ("ERR", "ERROR", "ALERT"),
    "MEDIUM": ("WARN", "WARNING", "NOTICE"),
    "LOW": ("INFO", "DEBUG", "TRACE", "VERBOSE"),
}

CONTEXT = (
    "production", r"prod(?!\w)", "outage", f"data[{WHITESPACE}]*loss",
    f"security[{WHITESPACE}]+breach", "ransomware", "exploit",
)
# Any match of the above holds one of these in lower case.
CONTEXT_TEXTS = ("prod", "outage", "loss", "breach", "ransomware", "exploit")
CONTEXT_BOOST = 10
REPETITION = ("repeated", "recurring", "frequent", "multiple", "consecutive")
REPETITION_BOOST = 5


def case(*branches: tuple[Column, Column]) -> Column:
    """``CASE WHEN`` over (condition, value) pairs."""
    (condition, value), *rest = branches
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain


def base_score(severity: Column) -> Column:
    return case(*[(severity == name, F.lit(value)) for name, value in BASE_SCORES.items()])


def score_to_level(score: Column) -> Column:
    return case(*[(score >= least, F.lit(name)) for name, least in THRESHOLDS]).otherwise(F.lit("LOW"))


def level_to_severity(level: Column) -> Column:
    """Severity of a level word; NULL for a missing or other word."""
    word = F.upper(level)
    return case(*[(word.isin(*words), F.lit(name)) for name, words in LEVEL_SEVERITY.items()])


def level_to_severity_default(level: Column) -> Column:
    """As above, but MEDIUM for a missing level and LOW for any other word."""
    missing = level.isNull() | (level == "")
    return F.when(missing, F.lit("MEDIUM")).otherwise(
        F.coalesce(level_to_severity(level), F.lit("LOW")))


def unknown_score(level: Column) -> Column:
    return base_score(level_to_severity_default(level))


def modifier_applied(rules: Sequence[Rule]) -> Column:
    """``struct<score, reason>`` of the modifier that decides, NULL if none does,
    from the columns ``raw_log`` and ``rank``.

    A modifier only ever raises the score, so the highest true one decides, the
    earlier of two equals; those not above the rule's base score never do.
    """
    branches, results = [], []
    for number, rule in enumerate(rules, start=1):
        raising = [m for m in rule.modifiers
                   if BASE_SCORES[m.severity] > BASE_SCORES[rule.severity]]
        for m in sorted(raising, key=lambda m: -BASE_SCORES[m.severity]):
            results.append({"score": BASE_SCORES[m.severity], "reason": m.reason})
            branches.append(f"WHEN rank = {number} AND raw_log RLIKE "
                            f"{sql_text(spark_regex(m.condition))} THEN {len(results)}")
    which = F.expr("CASE " + " ".join(branches) + " END" if branches else "CAST(NULL AS INT)")
    return F.try_element_at(constant(results, "array<struct<score:int,reason:string>>"), which)


def level_blend(score: Column, level: Column) -> Column:
    """Mean with the score of the line's own level, if that is higher; half up."""
    own = unknown_score(level)
    blended = F.floor((score + own + 1) / 2).cast("int")
    return F.when(level.isNotNull() & (own > score), blended).otherwise(score)


def context_boost(score: Column, line: Column) -> Column:
    hit = contains_any(F.lower(line), CONTEXT_TEXTS) & line.rlike("(?i)" + "|".join(CONTEXT))
    return F.least(score + F.when(hit, CONTEXT_BOOST).otherwise(0), F.lit(100))


def repetition_boost(score: Column, line: Column) -> Column:
    hit = contains_any(F.lower(line), REPETITION) & line.rlike("(?i)" + "|".join(REPETITION))
    return F.least(score + F.when(hit, REPETITION_BOOST).otherwise(0), F.lit(100))


def severity_clamp(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(100)), F.lit(0))
