import dataclasses
from collections import Counter

import pytest

from faultlore import catalogue as cat
from faultlore.functions.text import utc_day
from faultlore.operators.explaining import explain_logs


def test_size_and_totals():
    rules = cat.BUILTIN_RULES
    assert len(rules) == 61
    assert sum(len(r.patterns) for r in rules) == 319
    assert sum(len(r.modifiers) for r in rules) == 18
    assert Counter(r.severity for r in rules) == {"HIGH": 30, "MEDIUM": 18, "CRITICAL": 10, "LOW": 3}
    counts = Counter(r.category for r in rules)
    assert len(counts) == 23
    assert (counts["kubernetes"], counts["database"], counts["api"], counts["docker"]) == (7, 6, 6, 5)


def test_lint_and_advice():
    cat.check_rules(cat.BUILTIN_RULES)
    fixes = [f for r in cat.BUILTIN_RULES for f in r.recommended_fixes]
    assert len(fixes) == len(set(fixes))  # rules share no advice
    assert len({r.root_cause for r in cat.BUILTIN_RULES}) == 61
    assert all(r.summary and len(r.possible_causes) >= 3 for r in cat.BUILTIN_RULES)


@pytest.mark.parametrize("change", [
    {"category": "weather"}, {"severity": "BAD"}, {"patterns": ()}, {"keywords": ()},
    {"patterns": (r"a*",)}, {"rule_id": "DB_TIMEOUT"}, {"rule_id": "unknown"}])
def test_bad_rules_are_rejected(change):
    bad = dataclasses.replace(cat.BUILTIN_RULES[0], **change)
    with pytest.raises(ValueError):
        cat.check_rules((bad, *cat.BUILTIN_RULES[1:]))


def test_json_round_trip(tmp_path):
    path = str(tmp_path / "rules.json")
    cat.rules_to_json(cat.BUILTIN_RULES, path)
    assert cat.rules_from_json(path) == cat.BUILTIN_RULES


def test_rules_table(spark):
    rules = cat.read_rules(spark)
    assert rules.count() == 61
    assert cat.rule_by_id(rules, "SYS_OOM").first()["rank"] == 15
    stats = cat.kb_stats(rules).first()
    assert stats["total_patterns"] == 61
    assert stats["categories"][:4] == ["database", "network", "dns", "ssl_tls"]
    assert len(stats["categories"]) == 23


def own_rule(**changes):
    return dataclasses.replace(cat.BUILTIN_RULES[0], rule_id="OWN", **changes)


@pytest.mark.parametrize("rx", [r"(?=oops)oops", r"(?<!x)oops", r"(o)\1ps", "x*"])
def test_rules_are_checked_where_they_are_used(spark, rx):
    logs = spark.createDataFrame([("oops",)], "raw_log string")
    with pytest.raises(ValueError):
        explain_logs(logs, [own_rule(patterns=(rx,))])


def test_word_limits_of_own_rules_are_ascii(spark):
    logs = spark.createDataFrame([("größe oops",), ("éoops",), ("xoops",)], "raw_log string")
    got = [r["pattern_id"] for r in explain_logs(logs, [own_rule(patterns=(r"\boops\b",))]).collect()]
    assert got == ["OWN", "OWN", "unknown"]


def test_rule_file_through_spark(spark, tmp_path):
    path = str(tmp_path / "rules")
    cat.read_rules(spark).repartition(3).write.json(path)
    assert cat.read_rule_file(spark, path) == cat.BUILTIN_RULES


def test_usage_days_are_utc(spark):
    usage = spark.sql("SELECT timestamp_seconds(1706745599) AS created_at UNION ALL SELECT timestamp_seconds(1706745600)")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        days = sorted(str(r[0]) for r in usage.select(utc_day(usage, "created_at")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert days == ["2024-01-31", "2024-02-01"]
