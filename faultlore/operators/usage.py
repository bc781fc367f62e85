"""Usage analytics over request facts and API keys.

``usage``: ``api_key_id, endpoint, status_code, response_time_ms, created_at``.
``keys``: ``id, user_id, key_hash, key_prefix, name, is_active, created_at,
last_used_at, expires_at``.

Requests are summed per key, day and endpoint before they meet the keys, so a
key or an owner with a large share of all requests costs one partial aggregate
and no skewed join.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlore.functions.text import half_up, utc_day

# Fixed values from here on.

DEFAULT_DAYS = 30
MOST_DAYS = 90
KEYS_PER_USER = 10
RATE_LIMIT = 60
RATE_WINDOW = "60 seconds"


def days_limit(days: str | int | None) -> int:
    """Look-back in days: 30 unless a whole number is given, never above 90."""
    number = re.match(r"\s*[+-]?\d+", str(days if days is not None else ""))
    value = int(number.group()) if number else 0
    if value < 0:
        raise ValueError("days must not be negative")
    return min(value or DEFAULT_DAYS, MOST_DAYS)


def status_class(status: Column) -> Column:
    """Whether a status counts as success."""
    return status.between(200, 399)


def active_key_filter(keys: DataFrame, as_of: Column) -> DataFrame:
    """Active keys that have not run out; a key is still good at its very expiry."""
    return keys.filter(key_is_good(as_of))


def key_is_good(as_of: Column) -> Column:
    return F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def usage_recent_filter(usage: DataFrame, as_of: Column, days: int = DEFAULT_DAYS) -> DataFrame:
    return usage.filter(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))


def usage_for_user(usage: DataFrame, keys: DataFrame, user_id) -> DataFrame:
    own = keys.filter(F.col("user_id") == user_id).select(F.col("id").alias("api_key_id"))
    return usage.join(own, "api_key_id", "left_semi")


def day_partials(usage: DataFrame) -> DataFrame:
    """Requests per key, day (UTC) and endpoint: what reports are summed from, and partials can be summed on."""
    return usage.groupBy(
        "api_key_id", F.date_format(utc_day(usage, "created_at"), "yyyy-MM-dd").alias("day"), "endpoint"
    ).agg(
        F.count("*").alias("requests"),
        F.count_if(status_class(F.col("status_code"))).alias("successful"),
        F.sum(F.coalesce("response_time_ms", F.lit(0)).cast("bigint")).alias("response_ms"),
        F.max("created_at").alias("last_used"))


def owned(partials: DataFrame, keys: DataFrame) -> DataFrame:
    """Partials per owner, day and endpoint."""
    owners = keys.select(F.col("id").alias("api_key_id"), "user_id")
    return partials.join(owners, "api_key_id").groupBy("user_id", "day", "endpoint").agg(
        F.sum("requests").alias("requests"),
        F.sum("successful").alias("successful"),
        F.sum("response_ms").alias("response_ms"),
        F.max("last_used").alias("last_used"))


def usage_rollup(usage: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests per owner, day (UTC) and endpoint; every usage report is a sum of these."""
    return owned(day_partials(usage), keys)


def usage_totals(rollup: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Totals per owner.  With ``users`` (``user_id``), also zeros for idle ones."""
    total = F.col("total_requests")
    sums = rollup.groupBy("user_id").agg(
        F.sum("requests").alias("total_requests"),
        F.sum("successful").alias("successful_requests"),
        F.sum("response_ms").alias("response_ms"))
    if users is not None:
        sums = users.select("user_id").distinct().join(sums, "user_id", "left").fillna(0)
    return sums.select(
        "user_id", "total_requests", "successful_requests",
        (total - F.col("successful_requests")).alias("failed_requests"),
        F.when(total > 0, half_up(F.col("response_ms") / total)).otherwise(F.lit(0))
        .cast("bigint").alias("avg_response_time_ms"))


def usage_by_day(rollup: DataFrame) -> DataFrame:
    """Requests per owner and day, days ascending."""
    return (rollup.groupBy("user_id", "day").agg(F.sum("requests").alias("requests"))
            .orderBy("user_id", "day"))


def usage_by_endpoint(rollup: DataFrame) -> DataFrame:
    """Requests per owner and endpoint, most first, ties by latest use."""
    return (rollup.groupBy("user_id", "endpoint")
            .agg(F.sum("requests").alias("requests"), F.max("last_used").alias("last_used"))
            .orderBy("user_id", F.desc("requests"), F.desc("last_used"), "endpoint"))


def usage_stats(usage: DataFrame, keys: DataFrame, as_of: Column, days: int = DEFAULT_DAYS,
                users: DataFrame | None = None) -> DataFrame:
    """The whole usage report of every owner in one table:
    ``user_id, part, position, item, value``.

    Parts are the four totals, ``requests_by_day`` and ``requests_by_endpoint``.
    """
    return usage_stats_of(usage_rollup(usage_recent_filter(usage, as_of, days), keys), keys, users)


def usage_stats_of(rollup: DataFrame, keys: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The report from a rollup of the days it covers."""
    idle = (users if users is not None else keys).select("user_id").distinct()
    zeros = idle.select("user_id", *(F.lit(None).cast("string").alias(c) for c in ("day", "endpoint")),
                        *(F.lit(0).cast("bigint").alias(c) for c in ("requests", "successful", "response_ms")),
                        F.lit(None).cast(rollup.schema["last_used"].dataType).alias("last_used"))
    if users is not None:
        rollup = rollup.join(idle, "user_id", "left_semi")
    # the facts are read once: all parts come from one aggregate over grouping sets
    sums = rollup.unionByName(zeros).groupingSets(
        [["user_id"], ["user_id", "day"], ["user_id", "endpoint"]], "user_id", "day", "endpoint").agg(
        F.grouping_id().alias("part"), F.sum("requests").alias("requests"), F.sum("successful").alias("successful"),
        F.sum("response_ms").alias("response_ms"), F.max("last_used").alias("last_used"))
    whole, by_day = F.col("part") == 3, F.col("part") == 1
    order = Window.partitionBy("user_id", "part").orderBy(
        F.when(by_day, F.col("day")), F.desc(F.when(~by_day, F.col("requests"))),
        F.desc(F.when(~by_day, F.col("last_used"))), "endpoint")
    place = F.row_number().over(order)
    none = F.lit(None).cast("string")

    def row(part: str, position, item, value) -> Column:
        return F.struct(F.lit(part).alias("part"), position.alias("position"), item.alias("item"),
                        value.cast("bigint").alias("value"))

    total, good = F.col("requests"), F.col("successful")
    average = F.when(total > 0, half_up(F.col("response_ms") / total)).otherwise(F.lit(0))
    totals = F.array(*(row(name, F.lit(1), none, value) for name, value in (
        ("total_requests", total), ("successful_requests", good), ("failed_requests", total - good),
        ("avg_response_time_ms", average))))
    rows = F.when(whole, totals).when(by_day, F.array(row("requests_by_day", place, F.col("day"), total))).otherwise(
        F.array(row("requests_by_endpoint", place, F.col("endpoint"), total)))
    return sums.filter(whole | (total > 0)).select("user_id", rows.alias("rows")).select("user_id", F.inline("rows"))


def attribute_requests(requests: DataFrame, keys: DataFrame, as_of: Column, salts: int = 16) -> DataFrame:
    """Key and owner of each request by the hash of its ``presented_key``.

    Unknown, inactive or expired keys leave the request unauthorised.  The
    requests of one key, known or not, are dealt into ``salts`` parts, and the keys,
    far fewer than requests, are repeated as often: one busy client is no hot task.
    """
    known = keys.select(
        "key_hash", F.col("id").alias("api_key_id"), "user_id", "is_active", "expires_at",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    dealt = requests.withColumns({"key_hash": F.sha2("presented_key", 256),
                                  "_salt": F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")})
    joined = dealt.join(known, ["key_hash", "_salt"], "left")
    good = F.coalesce(key_is_good(as_of), F.lit(False))
    return (joined
            .withColumn("authorized", good)
            .withColumns({c: F.when(F.col("authorized"), F.col(c)) for c in ("api_key_id", "user_id")})
            .drop("key_hash", "_salt", "presented_key", "is_active", "expires_at"))


def last_used_per_key(usage: DataFrame) -> DataFrame:
    return usage.groupBy("api_key_id").agg(F.max("created_at").alias("last_used_at"))


def keys_per_user(keys: DataFrame) -> DataFrame:
    """Keys per owner, revoked ones too, and whether the owner may have no more."""
    return keys.groupBy("user_id").agg(F.count("*").alias("keys")).withColumn(
        "at_limit", F.col("keys") >= KEYS_PER_USER)


def keys_by_created(keys: DataFrame, user_id=None) -> DataFrame:
    """Keys newest first, without their hashes."""
    own = keys if user_id is None else keys.filter(F.col("user_id") == user_id)
    return own.select("id", "user_id", "key_prefix", "name", "is_active", "created_at",
                      "last_used_at", "expires_at").orderBy("user_id", F.desc("created_at"), "id")


def micros_of(window: str) -> int:
    """Length of an interval of whole microseconds, such as ``60 seconds``."""
    number, unit = window.split()
    length = {"microsecond": 1, "millisecond": 1000, "second": 10 ** 6, "minute": 60 * 10 ** 6,
              "hour": 3600 * 10 ** 6, "day": 86400 * 10 ** 6}[unit.removesuffix("s")]
    if int(number) < 1:
        raise ValueError("the window must be positive")
    return int(number) * length


def throttle_windows(requests: DataFrame, client: str = "client", at: str = "created_at",
                     window: str = RATE_WINDOW, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Windows that a client's first request opens: ``client, window_start, requests``.

    A window ends ``window`` after its first request, and the next request opens the
    next one.  Which requests open windows is found by pointer doubling: each request
    points to the first one that lies a window or more later, marks spread along
    pointers of 1, 2, 4, ... steps, and start at the requests that follow a pause of a
    window or more.  All joins are by client and clock-aligned stretch of time, in
    which at most one window begins, so a client with most requests is spread over
    its stretches.  ``store`` stores the tables of the rounds and returns them as read
    back; else rounds are checkpointed.

    Requests without a client or a time are left out.
    """
    width = micros_of(window)
    store = store or (lambda df: df.checkpoint())
    times = (requests.select(F.col(client).alias("client"), F.unix_micros(F.col(at).cast("timestamp")).alias("t")).dropna()
             .groupBy("client", "t").agg(F.count("*").alias("n")))
    # whole numbers only: the quotient of a double could be off at the edge of a stretch
    times = store(times.withColumn("stretch", F.expr(f"(t - pmod(t, {width}L)) div {width}L")))
    # a request's window ends one stretch later: the next one opens there, or else with the first request of the stretch
    # after that, or else after a pause
    first = times.groupBy("client", "stretch").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    ends = times.select("client", (F.col("stretch") + 1).alias("stretch"), (F.col("t") + width).alias("after"), F.col("t").alias("of"))
    asked = times.select("client", "stretch", F.col("t").alias("after"), F.lit(None).cast("bigint").alias("of"), F.col("t").alias("to"))
    later = Window.partitionBy("client", "stretch").orderBy(F.desc("after"), F.col("of").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    steps = (ends.withColumn("to", F.lit(None).cast("bigint")).unionByName(asked)
             .withColumn("to", F.last("to", ignorenulls=True).over(later)).filter("of IS NOT NULL")
             .join(first.select("client", (F.col("stretch") - 1).alias("stretch"), F.col("first").alias("next")), ["client", "stretch"], "left")
             .select("client", F.col("of").alias("t"), F.coalesce("to", "next").alias("to")).filter("to IS NOT NULL"))
    # a stretch that nothing precedes follows a pause
    paused = (first.join(first.select("client", (F.col("stretch") + 1).alias("stretch"), F.col("last").alias("before")),
                         ["client", "stretch"], "left"))
    pause = F.lag("t").over(Window.partitionBy("client", "stretch").orderBy("t"))
    starts = (times.withColumn("lag", pause).join(paused.select("client", "stretch", "before"), ["client", "stretch"])
              .filter(F.coalesce("lag", "before").isNull() | (F.col("t") - F.coalesce("lag", "before") >= width))
              .select("client", "t"))
    marked, steps = store(starts), store(steps)
    while not steps.isEmpty():
        reached = marked.join(steps, ["client", "t"]).select("client", F.col("to").alias("t"))
        marked = store(marked.union(reached).distinct())
        further = steps.select("client", F.col("t").alias("to"), F.col("to").alias("beyond"))
        steps = store(steps.join(further, ["client", "to"]).select("client", "t", F.col("beyond").alias("to")))
    opened = marked.select("client", F.col("t").alias("start"), F.explode(F.array(*(
        F.expr(f"(t - pmod(t, {width}L)) div {width}L") + i for i in (0, 1)))).alias("stretch"))
    counted = (times.join(opened, ["client", "stretch"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + width))
               .groupBy("client", "start").agg(F.sum("n").alias("requests")))
    kind = requests.schema[at].dataType
    return counted.select(F.col("client").alias(client), F.timestamp_micros("start").cast(kind).alias("window_start"), "requests")


def rate_limit_breaches(requests: DataFrame, client: str = "client", at: str = "created_at",
                        limit: int = RATE_LIMIT, window: str = RATE_WINDOW, aligned: bool = False,
                        store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Client windows with more requests than the limit.

    A client's first request opens a window (``throttle_windows``); ``aligned``
    counts by windows of the clock instead, without any order among requests.
    """
    if aligned:
        counted = (requests.groupBy(client, F.window(at, window).alias("w")).agg(F.count("*").alias("requests"))
                   .select(client, F.col("w.start").alias("window_start"), "requests"))
    else:
        counted = throttle_windows(requests, client, at, window, store)
    return counted.filter(F.col("requests") > limit)
