import random
import re


from pyspark.sql import functions as F

from faultlore.catalogue import BUILTIN_RULES
from faultlore.operators import explaining as ex
from faultlore.functions.slices import SLICE, Slices
from faultlore.operators import incidents as inc
from tests.fixtures import LINES

INCIDENTS = {
    "I1": [LINES["F18"], LINES["F19"], LINES["F20"]],
    "I2": [LINES["F09"], LINES["F04"]],
    "I3": ["ERROR orders ECONNREFUSED 172.16.4.9:5432",
           "ERROR gateway: request timeout while loading the cart"],
    "I4": [LINES["F04"], LINES["F05"]],
    "I5": [LINES["F22"], "2031-07-04T08:15:00Z ERROR orders ECONNREFUSED 172.16.4.9:5432",
           "2031-07-04T08:16:30Z ERROR spool ENOSPC no space left on device"],
    "I6": [],
    "I7": ["WARN hm", "hm"],
}


def logs_of(spark, incidents):
    rows = [(k, i, line) for k, lines in incidents.items() for i, line in enumerate(lines)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "incident_id string, seq long, raw_log string").repartition(3)


def test_summaries(spark):
    context = spark.createDataFrame(
        [(k, "the shop is slow for everybody" if k == "I1" else None) for k in INCIDENTS],
        "incident_id string, context string")
    got = {r["incident_id"]: r for r in inc.incident_summary(logs_of(spark, INCIDENTS), context).collect()}
    assert {k: (r["severity"], r["severity_score"]) for k, r in got.items()} == {
        "I1": ("CRITICAL", 95), "I2": ("CRITICAL", 90), "I3": ("HIGH", 70), "I4": ("HIGH", 70),
        "I5": ("CRITICAL", 95), "I6": ("LOW", 0), "I7": ("MEDIUM", 40)}

    first = got["I1"]
    assert first["title"] == ("CRITICAL Incident — 3 issue types detected across Database"
                              " — the shop is slow for everybody")
    assert first["affected_systems"] == ["database", "timeout", "api"]
    assert first["category_breakdown"] == {"database": 1, "timeout": 1, "api": 1}
    assert first["correlations"] == [inc.CORRELATIONS[0].text]
    assert first["summary"].startswith(
        "Analyzed 3 log entries. Overall severity: CRITICAL (score: 95/100). Affected systems: database, timeout, api."
        " 1 critical-severity log(s) require immediate attention. 2 high-severity log(s) detected."
        " Correlations found: Database issues")
    assert got["I3"]["correlations"] == [inc.CORRELATIONS[0].text]
    assert got["I4"]["title"] == "HIGH Incident — " + BUILTIN_RULES[0].summary[:80]
    assert got["I4"]["category_breakdown"] == {"database": 2}
    assert got["I5"]["correlations"] == [inc.CORRELATIONS[4].text]
    assert got["I5"]["category_breakdown"] == {"unknown": 1, "database": 1, "disk": 1}
    assert got["I5"]["recommended_actions"][:3] == list(ex.UNKNOWN_FIXES)
    assert (got["I6"]["title"], got["I6"]["total_logs_analyzed"], got["I6"]["correlations"]) == (
        "No Logs Provided", 0, [])
    assert got["I7"]["title"] == "MEDIUM Incident — Unrecognized Errors Detected"
    assert got["I7"]["affected_systems"] == [] and got["I7"]["root_cause_chain"] == []


def test_at_most_ten_actions_in_first_seen_order(spark):
    lines = [LINES[f] for f in ("F14", "F02", "F06", "F12", "F08")]
    got = inc.incident_summary(logs_of(spark, {"A": lines})).first()
    rules = {r.rule_id: r for r in BUILTIN_RULES}
    order = ["NET_PORT_IN_USE", "DB_CONN_REFUSED", "SYS_DISK_FULL", "NET_CONN_RESET", "SYS_OOM"]
    assert got["recommended_actions"] == [f for r in order for f in rules[r].recommended_fixes][:10]
    assert got["root_cause_chain"] == [rules[r].root_cause for r in order]


def test_two_rules_can_fill_the_actions(spark):
    got = inc.incident_summary(logs_of(spark, {"A": [LINES["F06"], LINES["F02"]]})).first()
    rules = {r.rule_id: r for r in BUILTIN_RULES}
    first, second = rules["SYS_DISK_FULL"].recommended_fixes, rules["DB_CONN_REFUSED"].recommended_fixes
    assert len(first) < 10 and got["recommended_actions"] == [*first, *second][:10]


def test_aggregate_severity(spark):
    groups = {"a": [58, 61, 72], "b": [81, 84], "c": [97] * 12, "d": [33], "e": [56] * 6}
    rows = [(g, s, "CRITICAL" if s >= 80 else "HIGH" if s >= 55 else "MEDIUM") for g, v in groups.items() for s in v]
    df = spark.createDataFrame(rows, "g string, severity_score int, severity string")
    got = {r["g"]: (r["severity_score"], r["severity"]) for r in inc.aggregate_severity(df, "g").collect()}
    assert got == {"a": (77, "HIGH"), "b": (94, "CRITICAL"), "c": (100, "CRITICAL"), "d": (33, "MEDIUM"), "e": (66, "HIGH")}


def test_top_category_ties_go_to_the_first_seen(spark):
    got = inc.incident_summary(logs_of(spark, {"A": [LINES["F06"], LINES["F02"]]})).first()
    assert got["title"].endswith("across Disk")


def test_own_correlation(spark):
    own = [inc.Correlation((("disk",), ("SYS_OOM", "SYS_CPU_HIGH")), "host is too small")]
    logs = logs_of(spark, {"A": [LINES["F06"], LINES["F08"]], "B": [LINES["F06"]]})
    got = {r["incident_id"]: r["correlations"] for r in inc.incident_summary(logs, correlations=own).collect()}
    assert got == {"A": ["host is too small"], "B": []}


def test_timeline_of_a_hot_incident(spark):
    """Positions equal a plain sort, with ranges far smaller than the incident."""
    rng = random.Random(5)
    stamps = [None, "2026-02-11T10:30:00Z", "2026-02-11T10:30:00Z", "2026-02-11T10:30:59Z",
              "2026-02-11T10:31:00Z", "2026-02-12 00:00:00", "Feb 11 10:30:00", "1700000000"]
    rows = []
    for incident, n in (("hot", 600), ("small", 7), ("one", 1)):
        rows += [(incident, i, f"{rng.choice(stamps) or ''} ERROR ECONNREFUSED 10.0.0.1:5432") for i in range(n)]
    logs = spark.createDataFrame(rows, "incident_id string, seq long, raw_log string").repartition(5)
    got = {}
    for r in inc.incident_timeline(logs, slices=20).collect():
        got.setdefault(r["incident_id"], []).append((r["position"], r["seq"], r["timestamp"]))
    for incident, n in (("hot", 600), ("small", 7), ("one", 1)):
        events = sorted(got[incident])
        assert [p for p, _, _ in events] == list(range(1, n + 1))
        assert [(t, s) for _, s, t in events] == sorted(
            ((t, s) for _, s, t in events), key=lambda e: (e[0] is None, e[0] or "", e[1]))


def test_timeline_pages_are_complete(spark):
    rows = [("long", i, f"{1700000000000 + i * 7919 % 1000003} ERROR disk {i}") for i in range(250)]
    logs = spark.createDataFrame(rows, "incident_id string, seq long, raw_log string")
    pages = {r["page"]: [e["position"] for e in r["timeline"]]
             for r in inc.incident_timeline_pages(inc.incident_timeline(logs)).collect()}
    assert pages == {p: list(range(100 * p + 1, min(250, 100 * p + 100) + 1)) for p in range(3)}


def test_timeline_keeps_lines_without_seq_and_never_sorts_an_incident(spark):
    stamps = ["1700000000123", "Feb 11 10:30:00", "2026-02-11T10:30:00Z", ""]
    rows = [("hot", None if i % 5 == 0 else i, f"{stamps[i % 4]} ERROR x {i}") for i in range(400)] + [(None, 1, "ERROR y")]
    logs = spark.createDataFrame(rows, "incident_id string, seq long, raw_log string")
    timeline = inc.incident_timeline(logs, slices=16)
    got = sorted((r["position"], r["timestamp"], r["seq"]) for r in timeline.collect())
    assert [p for p, _, _ in got] == list(range(1, 401))
    assert [(t, s) for _, t, s in got] == sorted(
        ((t, s) for _, t, s in got), key=lambda e: (e[0] is None, e[0] or "", e[1] is None, e[1] or 0))
    # one window over lines, by incident and range; the other runs over counts of ranges
    plan = timeline._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Window \[row_number", plan)) == 1 and len(re.findall(r"windowspecdefinition\(incident_id#\d+, _slice#\d+, ", plan)) == 1
    # the sort comes before the rules: lines are explained once, where they end up
    executed = timeline._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert plan.index("regexp_extract_all(") < plan.index("Window [row_number") and "Sort [" in executed


def test_ranges_of_large_groups_alone(spark):
    """Bounds are picked for groups with more than their share, and hold about as many rows each."""
    rows = [("hot", i * 7919 % 5003) for i in range(5000)] + [(f"k{i % 300}", i) for i in range(900)] + [(None, 1)]
    df = spark.createDataFrame(rows, "key string, at long").repartition(4)
    ranges = Slices(df, "key", [F.col("at")], slices=10)
    cut = ranges.cut(df)
    assert cut.count() == len(rows) and {r["key"] for r in ranges.bounds.collect()} == {"hot"}
    sizes = [r["count"] for r in cut.filter("key = 'hot'").groupBy(SLICE).count().collect()]
    assert sum(sizes) == 5000 and 6 <= len(sizes) <= 12 and max(sizes) < 1200
    assert cut.filter("key <> 'hot' OR key IS NULL").select(SLICE).distinct().collect() == [(0,)]
    highest = cut.filter("key = 'hot'").groupBy(SLICE).agg(F.min("at").alias("low"), F.max("at").alias("high")).orderBy(SLICE).collect()
    assert all(a["high"] < b["low"] for a, b in zip(highest, highest[1:]))
    assert Slices(df.filter("false"), "key", [F.col("at")]).cut(df).filter(f"{SLICE} <> 0").count() == 0


def test_timeline_in_the_order_of_a_locale(spark):
    """By code point, capitals come before all small letters; in a locale, letters of either case stay together."""
    rows = [("i", i, f"{t} ERROR x") for i, t in enumerate(["2026-02-11T10:30:00Z", "2026-02-11t10:30:00Z", "2026-02-11 10:30:00"])]
    logs = spark.createDataFrame(rows, "incident_id string, seq long, raw_log string")
    plain = [r["timestamp"] for r in inc.incident_timeline(logs).orderBy("position").collect()]
    assert plain == sorted(plain, key=lambda t: (t is None, t or ""))
    located = inc.incident_timeline(logs, collation="UNICODE")
    assert sorted(r["position"] for r in located.collect()) == [1, 2, 3]
    assert dict(located.dtypes)["timestamp"] == "string"
    assert "collate" in located._jdf.queryExecution().analyzed().toString().lower()


def test_counts_shrink_before_the_shuffle(spark):
    """Only partial counts per incident and rule cross the first exchange."""
    plan = inc.incident_rules(logs_of(spark, INCIDENTS))._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("hashpartitioning(incident_id", plan.index("hashpartitioning(incident_id") + 1)
    assert "partial_count" in plan[exchange:]
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_filters_stay_above_the_matcher(spark):
    known = ex.known_only(ex.explain_logs(logs_of(spark, INCIDENTS)))
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_summary_only_reads_what_it_needs(spark):
    total = ex.assess_logs(logs_of(spark, INCIDENTS)).select("seq", "severity_score")
    plan = total._jdf.queryExecution().optimizedPlan().toString()
    assert "https?" not in plan and "user(?:name)?" not in plan
