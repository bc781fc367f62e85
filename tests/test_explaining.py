import dataclasses
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from faultlore.catalogue import BUILTIN_RULES
from faultlore.operators import explaining as ex
from faultlore.operators import matching as mt
from tests.fixtures import LINES, brute_force, scored_lines


def explain(spark, lines, **kw):
    df = spark.createDataFrame(list(enumerate(lines)), "log_id long, raw_log string")
    return [r for r in sorted(ex.explain_logs(df, **kw).collect(), key=lambda r: r["log_id"])]


def test_scored_lines(spark):
    rows = scored_lines()
    assert len(rows) == 26
    for got, (fid, _, rule, confidence, level, score, severity, _) in zip(
            explain(spark, [r[1] for r in rows]), rows):
        assert (got["pattern_id"], got["confidence"], got["metadata"].get("logLevel", "null"),
                got["severity_score"], got["severity"]) == (
            rule, float(confidence), level, int(score), severity), fid


def test_other_candidates(spark):
    rows = scored_lines()
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "id string, raw_log string")
    found = {}
    for r in mt.rank_candidates(df).collect():
        found.setdefault(r["id"], {})[r["place"]] = (r["rule_id"], r["confidence"])
    for fid, *_, others in rows:
        expected = [] if others == "none" else [
            (a, float(b)) for a, b in (o.split() for o in others.split(", "))]
        got = [found.get(fid, {})[p] for p in sorted(found.get(fid, {})) if p > 1]
        assert got == expected, fid


def generated_lines():
    """A few lines per regex, some with text around, in odd letter case or non-ASCII."""
    lines = []
    for rule in BUILTIN_RULES:
        for rx in rule.patterns:
            @settings(max_examples=3, deadline=None, database=None, derandomize=True,
                      suppress_health_check=list(HealthCheck))
            @given(st.from_regex(re.compile(rx, re.A), fullmatch=True, alphabet=st.characters(
                min_codepoint=32, max_codepoint=126)))
            def take(text):
                lines.append(text)
            take()
    rng = random.Random(7)
    around = ["", "2026-02-11T10:30:00Z ERROR ", "\u00e9\u00fc ", "\U0001f525\U0001f525 ", "x\ny "]
    return [rng.choice(around) + (t.upper() if rng.random() < 0.3 else t) + rng.choice(around)
            for t in lines]


def test_candidates_equal_brute_force(spark):
    lines = generated_lines() + list(LINES.values()) + [" ", "plain text", "to be or not to be"]
    df = spark.createDataFrame(list(enumerate(lines)), "log_id long, raw_log string")
    found = {}
    for r in mt.rank_candidates(df).collect():
        found.setdefault(r["log_id"], []).append((r["place"], r["rule_id"], r["confidence"]))
    won = set()
    for i, line in enumerate(lines):
        expected = brute_force(line)
        assert [(a, b) for _, a, b in sorted(found.get(i, []))] == expected, line
        won |= {expected[0][0]} if expected else set()
    assert len(won) > 50


def test_white_space_beyond_ascii(spark):
    got = explain(spark, ["out\u00a0of\u2003memory", "out\u0085of memory"])
    assert [r["pattern_id"] for r in got] == ["SYS_OOM", "unknown"]


def test_keyword_candidates(spark):
    df = spark.createDataFrame([("FATAL: out of memory, ECONNREFUSED on redis",), ("nothing here",)], "raw_log string")
    got = sorted((r["place"], r["rule_id"]) for r in mt.keyword_candidates(df).collect())
    assert [r for _, r in got] == [
        "DB_CONN_REFUSED", "CACHE_REDIS_ERROR", "SYS_OOM", "K8S_OOM_KILLED", "CLOUD_LAMBDA_MEMORY"]


def test_severity_steps(spark):
    refused = "ECONNREFUSED 10.0.0.1:5432"
    got = explain(spark, [
        refused, refused + " in production", refused + " repeated", refused + " prod outage repeated",
        "login failed for admin", "login failed for admin, repeated", "token expired", "FATAL token expired"])
    assert [r["severity_score"] for r in got] == [70, 100, 75, 100, 70, 95, 15, 53]
    assert got[7]["severity"] == "MEDIUM"


def test_severity_reason(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([
        "login failed for admin", "login failed for bob", "WARN hm", "hm"])], "log_id long, raw_log string")
    got = [r["severity_reason"] for r in ex.assess_logs(df).orderBy("log_id").collect()]
    assert got == [
        "The target is a privileged account", "Base severity: MEDIUM (pattern: AUTH_LOGIN_FAILED)",
        "No known pattern matched. Severity derived from log level: WARN",
        "No known pattern matched. Severity derived from log level: unknown"]


def test_unknown(spark):
    got = explain(spark, ["ERROR: hm", "WARN: hm", "ALERT: hm", "hm 10.0.0.1 port=80"])
    assert [r["summary"] for r in got] == [
        ex.UNKNOWN_SUMMARY_ERROR, ex.UNKNOWN_SUMMARY_WARNING, ex.UNKNOWN_SUMMARY_OTHER % "ALERT", ex.UNKNOWN_SUMMARY]
    assert got[3]["metadata"] == {"ipAddress": "10.0.0.1"}
    assert all(r["confidence"] == 0 and r["category"] == "unknown" for r in got)


def test_source_and_kept_columns(spark):
    df = spark.createDataFrame([("a", "[svc] hm", "mine"), ("b", "[svc] hm", ""), ("c", "[svc] hm", None)],
                               "key string, raw_log string, source string")
    got = {r["key"]: r["source"] for r in ex.explain_logs(df).collect()}
    assert got == {"a": "mine", "b": "svc", "c": "svc"}


def test_own_rules(spark):
    own = (dataclasses.replace(BUILTIN_RULES[0], rule_id="DIGITS", patterns=(r"\d{6}",), modifiers=()),
           dataclasses.replace(BUILTIN_RULES[1], rule_id="QUOTES", patterns=(r"""it's "so" odd""",)))
    got = explain(spark, ["code 123456", 'it\'s "so" odd', "x"], rules=own)
    assert [r["pattern_id"] for r in got] == ["DIGITS", "QUOTES", "unknown"]


def test_null_line(spark):
    got = explain(spark, [None, "SIGABRT"])
    assert [r["pattern_id"] for r in got] == ["unknown", "SYS_PROCESS_CRASH"]


def test_projections_are_compiled_by_the_jvm(spark, capsys):
    """No generated method is beyond the 8,000 bytes up to which the JVM compiles one."""
    from faultlore.operators.explaining import assess_logs

    logs = spark.createDataFrame([(1, "ERROR a")], "log_id long, raw_log string")
    capsys.readouterr()
    assess_logs(logs).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
