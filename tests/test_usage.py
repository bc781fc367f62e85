import datetime as dt
import random
import hashlib

import pytest
from pyspark.sql import functions as F

from faultlore.operators import usage as us

D1, D2 = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 2, 10)
KEYS = "id string, user_id string, key_hash string, key_prefix string, name string, is_active boolean, " \
       "created_at timestamp, last_used_at timestamp, expires_at timestamp"
USAGE = "api_key_id string, endpoint string, status_code int, response_time_ms int, created_at timestamp"
AS_OF = dt.datetime(2024, 1, 31)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def keys(spark):
    def key(i, user, active=True, expires=None, made=D1):
        return (i, user, sha("raw-" + i), "raw-" + i, "Key", active, made, None, expires)
    return spark.createDataFrame([
        key("k1", "u1"), key("k2", "u1", active=False, made=D2), key("k3", "u2", expires=AS_OF),
        key("k4", "u3", expires=dt.datetime(2024, 1, 30))], KEYS)


def usage(spark):
    at = [D1 + dt.timedelta(seconds=i) for i in range(2)] + [D2 + dt.timedelta(seconds=i) for i in range(2)]
    return spark.createDataFrame([
        ("k1", "A", 200, 10, at[0]), ("k1", "A", 302, 20, at[1]), ("k1", "B", 404, 31, at[2]),
        ("k2", "B", 500, None, at[3]),
        ("k3", "C", 399, 10, D1), ("k3", "C", 400, 11, D2),
        ("k1", "old", 200, 1, dt.datetime(2023, 1, 1)), ("gone", "A", 200, 1, D1)], USAGE)


def report(spark, users=None):
    df = us.usage_stats(usage(spark), keys(spark), F.lit(AS_OF), users=users)
    out = {}
    for r in df.orderBy("user_id", "part", "position").collect():
        out.setdefault(r["user_id"], {}).setdefault(r["part"], []).append((r["item"], r["value"]))
    return out


def test_usage_stats(spark):
    got = report(spark)
    assert got["u1"] == {
        "total_requests": [(None, 4)], "successful_requests": [(None, 2)], "failed_requests": [(None, 2)],
        "avg_response_time_ms": [(None, 15)],
        "requests_by_day": [("2024-01-01", 2), ("2024-01-02", 2)],
        "requests_by_endpoint": [("B", 2), ("A", 2)]}  # a tie goes to the later use
    assert got["u2"]["successful_requests"] == [(None, 1)]
    assert got["u2"]["avg_response_time_ms"] == [(None, 11)]  # 10.5 rounds up
    assert got["u3"] == {p: [(None, 0)] for p in (
        "total_requests", "successful_requests", "failed_requests", "avg_response_time_ms")}


def test_users_without_keys(spark):
    users = spark.createDataFrame([("u1",), ("nobody",)], "user_id string")
    assert report(spark, users)["nobody"]["total_requests"] == [(None, 0)]


def test_active_keys(spark):
    got = us.active_key_filter(keys(spark), F.lit(AS_OF)).select("id").collect()
    assert sorted(r[0] for r in got) == ["k1", "k3"]  # k3 runs out at that very moment


def test_attribute_requests(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(
        ["raw-k1", "raw-k2", "raw-k3", "raw-k4", "raw-none", None])], "request_id int, presented_key string")
    got = {r["request_id"]: (r["authorized"], r["user_id"]) for r in
           us.attribute_requests(df, keys(spark), F.lit(AS_OF)).collect()}
    assert got == {0: (True, "u1"), 1: (False, None), 2: (True, "u2"), 3: (False, None), 4: (False, None), 5: (False, None)}


def test_small_operators(spark):
    assert us.usage_for_user(usage(spark), keys(spark), "u1").count() == 5
    last = {r["api_key_id"]: r["last_used_at"] for r in us.last_used_per_key(usage(spark)).collect()}
    assert last["k3"] == D2
    owners = {r["user_id"]: (r["keys"], r["at_limit"]) for r in us.keys_per_user(keys(spark)).collect()}
    assert owners == {"u1": (2, False), "u2": (1, False), "u3": (1, False)}
    newest = us.keys_by_created(keys(spark), "u1")
    assert [r["id"] for r in newest.collect()] == ["k2", "k1"] and "key_hash" not in newest.columns


@pytest.mark.parametrize("given,days", [
    (None, 30), ("", 30), ("soon", 30), ("0", 30), ("7", 7), ("12 days", 12), (400, 90), ("90", 90)])
def test_days_limit(given, days):
    assert us.days_limit(given) == days


def test_negative_days():
    with pytest.raises(ValueError):
        us.days_limit("-3")


def test_rate_limit(spark):
    """A window opens with a client's first request and ends 60 s later to the microsecond."""
    start = D1 + dt.timedelta(seconds=30)
    rows = [("a", start + dt.timedelta(seconds=i % 60)) for i in range(61)]
    rows += [("b", start + dt.timedelta(seconds=i)) for i in range(60)] + [("a", start + dt.timedelta(seconds=60))]
    df = spark.createDataFrame(rows, "client string, created_at timestamp")
    got = [(r["client"], r["window_start"], r["requests"]) for r in us.rate_limit_breaches(df).collect()]
    assert got == [("a", start, 61)]
    # windows of the clock see at most 31 in either minute
    assert us.rate_limit_breaches(df, aligned=True).count() == 0
    assert {r["requests"] for r in us.rate_limit_breaches(df, aligned=True, limit=30).collect()} == {31}


def windows_by_force(rows, seconds):
    out, opened = {}, {}
    for client, t in sorted(r for r in rows if None not in r):
        if client not in opened or t >= opened[client] + dt.timedelta(seconds=seconds):
            opened[client] = t
        out[client, opened[client]] = out.get((client, opened[client]), 0) + 1
    return out


@pytest.mark.parametrize("seconds", [1, 7, 60])
def test_throttle_windows(spark, seconds):
    """A client with half of all requests, one at a steady rate, pauses, ties, and requests at the very edge."""
    rng = random.Random(seconds)

    def at(micros):
        return D1 + dt.timedelta(microseconds=micros)

    rows = [("busy", at(rng.randrange(200_000_000))) for _ in range(600)]
    rows += [("steady", at(1_000_000 * i)) for i in range(150)]
    rows += [("edge", at(500_000 + k * seconds * 1_000_000 + d)) for k in range(40) for d in (-1, 0, 1)]
    rows += [("pauses", at(rng.randrange(20) * 100_000_000 + rng.randrange(9_000_000))) for _ in range(150)]
    rows += [("twice", at(5))] * 4 + [("before", D1 - dt.timedelta(days=20000, microseconds=-3))] * 2
    rows += [(f"c{rng.randrange(60)}", at(rng.randrange(300_000_000))) for _ in range(200)]
    rows += [(None, at(1)), ("none", None)]
    df = spark.createDataFrame(rows, "client string, created_at timestamp").repartition(3)
    found = us.throttle_windows(df, window=f"{seconds} seconds")
    assert {(r["client"], r["window_start"]): r["requests"] for r in found.collect()} == windows_by_force(rows, seconds)


def test_no_requests_and_odd_windows(spark):
    none = spark.createDataFrame([], "client string, created_at timestamp")
    assert us.throttle_windows(none).collect() == []
    with pytest.raises(ValueError):
        us.throttle_windows(none, window="0 seconds")


def test_requests_are_summed_before_the_join(spark):
    plan = us.usage_rollup(usage(spark), keys(spark))._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "Aggregate [api_key_id" in plan[join:]
