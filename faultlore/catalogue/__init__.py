"""Rules as data: the built-in catalogue, user-supplied rules and checks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlore.catalogue.advice import ADVICE
from faultlore.catalogue.signals import CATEGORIES, SIGNALS
from faultlore.functions.regexes import in_dialect

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class Modifier:
    condition: str
    severity: str
    reason: str


@dataclass(frozen=True)
class Rule:
    """One rule.  Position in the catalogue is the tie-break between rules."""

    rule_id: str
    name: str
    category: str
    severity: str
    patterns: tuple[str, ...]
    keywords: tuple[str, ...]
    error_codes: tuple[str, ...] = ()
    modifiers: tuple[Modifier, ...] = ()
    summary: str = ""
    root_cause: str = ""
    possible_causes: tuple[str, ...] = ()
    recommended_fixes: tuple[str, ...] = field(default=())


RULES_SCHEMA = T.StructType([
    T.StructField("rank", T.IntegerType(), False),
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("error_codes", T.ArrayType(T.StringType())),
    T.StructField("modifiers", T.ArrayType(T.StructType([
        T.StructField("condition", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]))),
    T.StructField("summary", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("possible_causes", T.ArrayType(T.StringType())),
    T.StructField("recommended_fixes", T.ArrayType(T.StringType())),
])


def _builtin() -> tuple[Rule, ...]:
    rules = []
    for s in SIGNALS:
        a = ADVICE[s.rule_id]
        rules.append(Rule(
            s.rule_id, s.name, s.category, s.severity,
            s.patterns, s.keywords, s.error_codes,
            tuple(Modifier(cond, sev, reason) for (cond, sev), reason
                  in zip(s.modifiers, a.modifier_reasons, strict=True)),
            a.summary, a.root_cause, a.causes, a.fixes))
    return tuple(rules)


BUILTIN_RULES: tuple[Rule, ...] = _builtin()


def check_rules(rules: Sequence[Rule]) -> None:
    """Reject a catalogue that could not be matched or scored."""
    seen: set[str] = set()
    for r in rules:
        if r.rule_id in seen or r.rule_id == "unknown":
            raise ValueError(f"rule id {r.rule_id!r} is taken")
        seen.add(r.rule_id)
        if r.category not in CATEGORIES:
            raise ValueError(f"{r.rule_id}: unknown category {r.category!r}")
        if r.severity not in SEVERITIES or any(m.severity not in SEVERITIES for m in r.modifiers):
            raise ValueError(f"{r.rule_id}: unknown severity")
        if not r.patterns or not r.keywords:
            raise ValueError(f"{r.rule_id}: needs a regex and a keyword")
        for rx in (*r.patterns, *(m.condition for m in r.modifiers)):
            if re.compile(rx).search("") is not None:
                raise ValueError(f"{r.rule_id}: regex {rx!r} matches empty text")
            if not in_dialect(rx):
                raise ValueError(f"{r.rule_id}: regex {rx!r} has look-around or back-references")


def rules_from_json(path: str) -> tuple[Rule, ...]:
    """Read a user's own rules: a JSON list of records shaped like ``Rule``."""
    with open(path, encoding="utf-8") as fh:
        records = json.load(fh)
    rules = tuple(
        Rule(**{
            k: tuple(Modifier(**m) for m in v) if k == "modifiers"
            else tuple(v) if isinstance(v, list) else v
            for k, v in rec.items()})
        for rec in records)
    check_rules(rules)
    return rules


def rules_from_table(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table like that of ``read_rules``, in order of ``rank``, checked.

    A catalogue is small by nature: it becomes literals of the plan.
    """
    given = [f.name for f in RULES_SCHEMA if f.name in table.columns and f.name != "rank"]
    rules = []
    for row in table.orderBy("rank").select(*given).toLocalIterator():
        fields = {k: tuple(v) if isinstance(v, list) else v for k, v in row.asDict().items() if v is not None}
        fields["modifiers"] = tuple(Modifier(**m.asDict()) for m in fields.get("modifiers", ()))
        rules.append(Rule(**fields))
    check_rules(rules)
    return tuple(rules)


def read_rule_file(spark: SparkSession, path: str, fmt: str = "json") -> tuple[Rule, ...]:
    """Rules from a file on any storage Spark reads; each record carries its ``rank``."""
    return rules_from_table(spark.read.format(fmt).schema(RULES_SCHEMA).load(path))


def rules_to_json(rules: Iterable[Rule], path: str) -> None:
    with open(path, "w", encoding="utf-8") as fh:
        json.dump([asdict(r) for r in rules], fh, indent=1, ensure_ascii=False)


def read_rules(spark: SparkSession, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """The catalogue as a table, one row per rule, ranked by registration order."""
    rows = [(i, r.rule_id, r.name, r.category, r.severity, list(r.patterns),
             list(r.keywords), list(r.error_codes),
             [(m.condition, m.severity, m.reason) for m in r.modifiers],
             r.summary, r.root_cause, list(r.possible_causes), list(r.recommended_fixes))
            for i, r in enumerate(rules, start=1)]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def rule_by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.filter(F.col("rule_id") == rule_id)


def kb_stats(rules: DataFrame) -> DataFrame:
    """Rule count and the distinct categories in registration order (one row)."""
    per_category = rules.groupBy("category").agg(
        F.count("*").alias("n"), F.min("rank").alias("first_rank"))
    ordered = F.array_sort(F.collect_list(F.struct("first_rank", "category")))
    return per_category.agg(
        F.sum("n").alias("total_patterns"),
        F.transform(ordered, lambda c: c["category"]).alias("categories"))
