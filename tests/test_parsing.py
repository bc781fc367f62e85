import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultlore.functions import severity as sv
from faultlore.operators import parsing as ps

CASES = [
    ("2026-02-11T10:30:00Z ERROR something failed", "timestamp", "2026-02-11T10:30:00Z"),
    ("2026-02-11T10:30:00.123Z ERROR something failed", "timestamp", "2026-02-11T10:30:00.123Z"),
    ("2026-02-11T10:30:00+05:30 ERROR something failed", "timestamp", "2026-02-11T10:30:00+05:30"),
    ("Feb 11 10:30:00 myhost ERROR something failed", "timestamp", "Feb 11 10:30:00"),
    ("2026-02-11 10:30:00 ERROR something failed", "timestamp", "2026-02-11 10:30:00"),
    ("at 1700000000 x", "timestamp", "1700000000"),
    ("at 1700000000123 x", "timestamp", "1700000000123"),
    ("10.0.0.1 - - [11/Feb/2026:10:30:00 +0000] GET /", "timestamp", "11/Feb/2026:10:30:00 +0000"),
    # the first form wins even if another occurs earlier
    ("1700000000 then 2026-02-11T10:30:00Z", "timestamp", "2026-02-11T10:30:00Z"),
    ("ERROR: connection refused", "timestamp", None),
    ("error: something failed", "log_level", "ERROR"),
    ("Connection to server lost", "log_level", None),
    ("EMERGENCY stop", "log_level", "EMERGENCY"),
    ("ERR stop", "log_level", "ERR"),
    ("ERROR: ECONNREFUSED 192.168.1.100:5432", "ip_address", "192.168.1.100"),
    ("ERROR: ECONNREFUSED 10.0.1.5:5432", "port", "5432"),
    ("ERROR: disk full", "ip_address", None),
    ("Connection refused to 10.0.0.1:3306", "port", "3306"),
    ("ERROR: bind failed port=8080", "port", "8080"),
    ("10.0.0.1 via 10.0.0.2:99 then 10.0.0.1:3306", "port", "3306"),
    ("Error: ECONNREFUSED 127.0.0.1:5432", "error_code", "ECONNREFUSED"),
    ("ENOSPC: no space left on device", "error_code", "ENOSPC"),
    ("Error: ENOENT: no such file or directory", "error_code", "ENOENT"),
    ("connect ETIMEDOUT 10.0.0.1:443", "error_code", "ETIMEDOUT"),
    ("ERROR: simple failure message", "error_code", "SIMPLE"),
    ("ERROR: disk full", "error_code", "DISK"),
    ("answered 404 Not Found", "error_code", "404"),
    ("quit code='x_1'", "error_code", "X_1"),
    ("xECONNREFUSED or EPIPES, then EPIPE", "error_code", "EPIPE"),
    ("EPIPE", "error_code", "EPIPE"),
    ("code: error", "error_code", None),
    ("GET /api/v1/users 200 OK", "http_method", "GET"),
    ("503 Service Unavailable - upstream server not responding", "http_status", "503"),
    ('"HTTP/1.1" 403', "http_status", "403"),
    ("status=429", "http_status", "429"),
    ("ERROR: Request timeout on /api/v1/users after 30000ms", "url", "/api/v1/users"),
    ("foo and/or bar", "url", "/or"),
    ('FATAL: password authentication failed for user "admin"', "username", "admin"),
    ("for user bob. Next", "username", "bob"),
    ("2026-02-11T10:30:00Z ERROR [database] FATAL: connection refused", "extracted_source", "database"),
    ("Feb 11 10:30:00 myhost nginx[12345]: error occurred", "extracted_source", "12345"),
    ("see app.service now", "extracted_source", "app.service"),
    ("worker-1 | started", "extracted_source", "worker-1"),
    ("(job-7) started", "extracted_source", "job-7"),
    ("a [b c] (d) e", "extracted_source", "d"),
    ("2026-02-11T10:30:00Z ERROR: something went wrong", "message_body", "ERROR: something went wrong"),
    ("  2026-02-11T10:30:00Z - text \t", "message_body", "text"),
    ("WARN retry at 10:30:00 later", "port", "00"),
    ("pid=42 x", "pid", "42"),
    ("nginx[77]: pid 5", "pid", "77"),
    ("x 999.1.1.1 y", "ip_address", "999.1.1.1"),
    ("open /a/b.c/d, done", "file_path", "/a/b.c/d"),
    ("open /a/b//c", "file_path", "/a/b"),
    ("open /a/b/ now", "file_path", "/a/b"),
    ("open /a now", "file_path", None),
    ("open C:\\data\\in\\f.csv now", "file_path", "C:\\data\\in\\f.csv"),
    ("open C:\\data\\\\f", "file_path", "C:\\data"),
    # only ASCII counts as part of a word
    ("\u00e9ERROR\u00e9 text", "log_level", "ERROR"),
    ("\u00a0\ufeff text \u2003", "message_body", "text"),
]


def test_fields(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "log_id long, raw_log string")
    rows = {r["log_id"]: r for r in ps.parse_log_line(df).collect()}
    for i, (line, field, expected) in enumerate(CASES):
        assert rows[i][field] == expected, (line, field)


def test_long_path_does_not_recurse(spark):
    path = "/x" * 20000
    df = spark.createDataFrame([(path + " \\ end",)], "raw_log string")
    assert ps.parse_log_line(df).select("file_path").first()[0] == path


def test_reject_empty_logs(spark):
    df = spark.createDataFrame([("",), (" ",), (None,), ("x",)], "raw_log string")
    assert sorted(r[0] for r in ps.reject_empty_logs(df).collect()) == [" ", "x"]


@pytest.mark.parametrize("words,severity", [
    (("EMERG", "EMERGENCY", "FATAL", "CRIT", "critical"), "CRITICAL"), (("ERR", "ERROR", "alert"), "HIGH"),
    (("WARN", "WARNING", "NOTICE"), "MEDIUM"), (("INFO", "DEBUG", "TRACE", "VERBOSE"), "LOW"),
    (("OTHER", None), None)])
def test_levels(spark, words, severity):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select(sv.level_to_severity(F.col("w")).alias("a"),
                    sv.level_to_severity_default(F.col("w")).alias("b")).collect()
    assert {r["a"] for r in got} == {severity}
    assert {r["b"] for r in got} == ({severity} if severity else {"LOW", "MEDIUM"})


def test_event_time(spark):
    stamps = ["2026-02-11T10:30:00Z", "2026-02-11 10:30:00", "Feb 1 10:30:00", "01/Feb/2026:10:30:00 +0000",
              "1700000000", "1700000000000", "Foo 99 10:30:00", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, s string")
    got = [r[0] for r in df.select("i", ps.event_time(F.col("s"), 2026).alias("t")).orderBy("i").select("t").collect()]
    feb = dt.datetime(2026, 2, 1, 10, 30)
    assert got == [feb.replace(day=11), feb.replace(day=11), feb, feb,
                   dt.datetime(2023, 11, 14, 22, 13, 20), dt.datetime(2023, 11, 14, 22, 13, 20), None, None]


@pytest.mark.parametrize("slices", [1, 9])
def test_years_follow_from_the_order_of_lines(spark, slices):
    """Three New Years, lines out of order around them, stamps with a year in between, and a second sequence."""
    rng = random.Random(3)
    start = dt.datetime(2022, 12, 20)
    times = [start + dt.timedelta(hours=5 * i) for i in range(4000)]  # until 2025
    rows = []
    for i, t in enumerate(times):
        t += dt.timedelta(hours=rng.choice([0, 0, 0, -30, 17]))
        form = rng.choice(["%b %d %H:%M:%S"] * 4 + ["%Y-%m-%d %H:%M:%S", ""])
        rows.append(("a", i, f"{t:%b} {t.day:2d} {t:%H:%M:%S}" if form.startswith("%b") else t.strftime(form) or None, t if form else None))
    rows += [("b", i, t.strftime("%b %d %H:%M:%S"), t) for i, t in enumerate([dt.datetime(2022, 12, 31, 23, 59, 59), dt.datetime(2023, 1, 1)])]
    df = spark.createDataFrame(rows, "host string, seq long, timestamp string, want timestamp").repartition(4)
    old = spark.conf.get("spark.sql.session.timeZone")
    got = ps.with_event_time(df, 2022, key="host", slices=slices)
    assert got.columns == ["host", "seq", "timestamp", "want", "event_time"]
    assert got.filter("NOT event_time <=> want").collect() == []
    # a sequence without a key, and times in a zone of their own, whatever the session's
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        zoned = ps.with_event_time(df.filter("host = 'b'"), 2022, zone="Europe/Berlin").select(F.unix_timestamp("event_time")).orderBy("seq")
        assert [r[0] for r in zoned.collect()] == [1672527599, 1672527600]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_a_code_is_compared_with_level_words_and_not_searched(spark):
    plan = ps.parse_log_line(spark.createDataFrame([("x",)], "raw_log string")).select("error_code")._jdf.queryExecution().optimizedPlan()
    assert "regexp_replace" not in plan.toString()


def test_fields_at_the_edges_of_words(spark):
    """Texts that begin a field inside a word, in mixed case or after odd blanks, count as little or as much as ever."""
    lines = {
        "xEABCD": {}, "a EABCD z": {"error_code": "EABCD"}, "xERROR CODE: 7a": {"error_code": "7A"},
        "Err_Code=ab1": {"error_code": "AB1"}, "x123 Not": {}, "123 Not x": {"error_code": "123"},
        "xcode=a1": {}, "(Code='a1'": {"error_code": "A1"}, "1.2.3.4444": {}, "v1.2.3.4": {}, "é1.2.3.4": {"ip_address": "1.2.3.4"},
        "export=8080": {}, "PORT　8080": {"port": "8080"}, "xuser=a": {}, "UserName:'b'": {"username": "b"},
        "HTTP/1.1\" 404": {"http_status": "404"}, "xstatus=404": {}, "Status 404": {"http_status": "404"},
        "404 not found": {"http_status": "404", "error_code": None}, "xPOST POSTx": {}, "xPID 12 [12]": {"pid": "12"},
        "[a b] (c)": {"extracted_source": "c"}, "[a) (b]": {}, "91700000000": {}, "at 1700000000.": {"timestamp": "1700000000"},
    }
    fields = ("timestamp", "ip_address", "error_code", "port", "username", "http_status", "http_method", "pid", "extracted_source")
    logs = spark.createDataFrame([(line,) for line in lines], "raw_log string")
    for row in ps.parse_log_line(logs).collect():
        for name, value in lines[row["raw_log"]].items():
            assert row[name] == value, (row["raw_log"], name, row[name])
        if not lines[row["raw_log"]]:
            assert [row[f] for f in fields] == [None] * len(fields), row
