"""Windowed operators for streams of log lines and requests.

All but throttling work on batch tables too, where they need no watermark.  State is a
fixed number of counters per key and window, never a list of lines.
``explain_logs`` is row-wise and applies to streams as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from faultlore.catalogue import BUILTIN_RULES, Rule
from faultlore.functions.metadata import override_source
from faultlore.functions.slices import SLICE, Slices
from faultlore.functions.text import half_up
from faultlore.operators.explaining import UNKNOWN, assess_logs, explain_logs
from faultlore.operators.incidents import severity_counts, with_aggregate_severity
from faultlore.operators.usage import RATE_WINDOW, micros_of, rate_limit_breaches, status_class
from faultlore.sources.stored import stored_once

stream_explain = explain_logs


def _marked(df: DataFrame, at: str, late: str | None) -> DataFrame:
    return df if late is None else df.withWatermark(at, late)


def _category_names(rules: Sequence[Rule]) -> list[str]:
    return sorted({r.category for r in rules} | {UNKNOWN})


def _counts(rules: Sequence[Rule]) -> list[Column]:
    """Severity counts and one counter per category."""
    return severity_counts() + [
        F.count_if(F.col("category") == c).alias(f"_n_{c}") for c in _category_names(rules)]


def _summed(rules: Sequence[Rule]) -> list[Column]:
    """The same from counts of smaller groups."""
    counters = ["total_logs", "high_scores", "critical_scores", "critical_logs", "high_logs"]
    counters += [f"_n_{c}" for c in _category_names(rules)]
    return [F.max("max_score").alias("max_score"), *[F.sum(c).alias(c) for c in counters]]


def _assessed(logs: DataFrame, late: str | None, rules: Sequence[Rule]) -> DataFrame:
    given = F.col("source") if "source" in logs.columns else F.lit(None).cast("string")
    return assess_logs(_marked(logs, "event_time", late), rules).select(
        "event_time", "category", "severity", "severity_score",
        F.coalesce(override_source(F.col("extracted_source"), given), F.lit("")).alias("source"))


def _reported(counted: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    pairs = [x for c in _category_names(rules) for x in (F.lit(c), F.col(f"_n_{c}"))]
    return with_aggregate_severity(counted).select(
        "source", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "total_logs", "severity", "severity_score", "critical_logs", "high_logs",
        F.map_filter(F.create_map(*pairs), lambda _, n: n > 0).alias("category_breakdown"))


def stream_incident_windows(logs: DataFrame, window: str = "1 hour", late: str | None = "10 minutes",
                            rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Severity and category counts per source and fixed window of ``event_time``."""
    assessed = _assessed(logs, late, rules)
    return _reported(assessed.groupBy("source", F.window("event_time", window).alias("w"))
                     .agg(*_counts(rules)), rules)


def stream_incident_sessions(logs: DataFrame, gap_seconds: int = 1800, late: str | None = "10 minutes",
                             rules: Sequence[Rule] = BUILTIN_RULES, slices: int | None = None) -> DataFrame:
    """The same per burst of lines of a source, ended by a gap of at least ``gap_seconds``.

    On a table, lines are first counted per source and second, which no gap can
    split.  A source with more than its share of all lines is cut into ranges of
    time; a session begins where the lines before it, whose latest time is carried
    from range to range, are a gap away, and is named by its beginning, carried
    likewise.  No window or session is keyed by source alone.  Lines are assessed once,
    into a slim table in ``spark.checkpoint.dir`` that all of this reads.

    A stream is to be started under ``runs.partial_sessions``: each task then merges its own
    lines into partial sessions by interval, and a source's state meets one row per
    task and session in place of all lines.
    """
    if logs.isStreaming:
        assessed = _assessed(logs, late, rules)
        window = F.session_window("event_time", f"{gap_seconds} seconds").alias("w")
        return _reported(assessed.groupBy("source", window).agg(*_counts(rules)), rules)
    gap = gap_seconds * 1_000_000
    lines = stored_once(_assessed(logs, None, rules), "sessions").withColumn("_second", F.date_trunc("second", "event_time"))
    seen = lines.select("source", "_second", "event_time")
    ranges = Slices(seen, "source", [F.col("_second")], slices)
    ordered = Window.partitionBy("source", SLICE).orderBy("_second")

    def begun(seconds: DataFrame, latest: DataFrame) -> DataFrame:
        """Adds the beginning of a session in the seconds that begin one."""
        carried = ranges.with_carry(seconds.withColumn("_lag", F.lag("_last").over(ordered)), latest, _carried=F.max("_latest"))
        before = F.coalesce("_lag", "_carried")
        fresh = before.isNull() | (F.unix_micros("_first") - F.unix_micros(before) >= gap)
        return carried.withColumn("_begins", F.when(fresh, F.col("_first"))).drop("_lag", "_carried")

    # of the sources with several ranges, from times alone: what each range hands on
    times = ranges.cut_only(seen).groupBy("source", SLICE, "_second").agg(
        F.min("event_time").alias("_first"), F.max("event_time").alias("_last"))
    latest = times.groupBy("source", SLICE).agg(F.max("_last").alias("_latest"))
    opened = begun(times, latest).groupBy("source", SLICE).agg(F.max("_begins").alias("_opened"))

    seconds = lines.groupBy("source", "_second").agg(F.min("event_time").alias("_first"), F.max("event_time").alias("_last"), *_counts(rules))
    seconds = begun(ranges.cut(seconds), latest)
    running = F.max("_begins").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sessions = ranges.with_carry(seconds.withColumn("_running", running), opened, _from=F.max("_opened"))
    ended = F.timestamp_micros(F.unix_micros(F.max("_last")) + gap).cast(logs.schema["event_time"].dataType)
    counted = (sessions.groupBy("source", F.coalesce("_running", "_from").alias("_session"))
               .agg(F.min("_first").alias("_start"), ended.alias("_end"), *_summed(rules)))
    return _reported(counted.withColumn("w", F.struct(F.col("_start").alias("start"), F.col("_end").alias("end"))), rules)


def stream_usage_by_minute(usage: DataFrame, window: str = "1 minute", late: str | None = "10 minutes",
                           ) -> DataFrame:
    """Request totals per endpoint and window of ``created_at``."""
    return (_marked(usage, "created_at", late)
            .groupBy("endpoint", F.window("created_at", window).alias("w"))
            .agg(F.count("*").alias("total_requests"),
                 F.count_if(status_class(F.col("status_code"))).alias("successful_requests"),
                 F.sum(F.coalesce("response_time_ms", F.lit(0)).cast("bigint")).alias("_ms"))
            .select("endpoint", F.col("w.start").alias("window_start"),
                    "total_requests", "successful_requests",
                    (F.col("total_requests") - F.col("successful_requests")).alias("failed_requests"),
                    half_up(F.col("_ms") / F.col("total_requests")).alias("avg_response_time_ms")))


def stream_rate_limit_breaches(requests: DataFrame, late: str = "10 minutes", **options) -> DataFrame:
    """Clock-aligned windows over the limit, once they have ended."""
    at = options.get("at", "created_at")
    return rate_limit_breaches(requests.withWatermark(at, late), aligned=True, **options)


def stream_throttle_windows(requests: DataFrame, client: str = "client", at: str = "created_at", window: str = RATE_WINDOW,
                            late: str = "10 minutes") -> DataFrame:
    """``throttle_windows`` on a stream: ``client, window_start, requests`` of each window, once the watermark has passed its end.

    A client's state is its open window and the counts of the times that the watermark has
    not reached yet; a timer wakes it for the next of these.  Requests later than
    ``late`` are left out.
    """
    width = micros_of(window)

    def windows(key, parts, state):
        passed = state.getCurrentWatermarkMs() * 1000
        start, count, times, counts = state.get if state.exists else (None, 0, [], [])
        pending = dict(zip(times, counts))
        if not state.hasTimedOut:
            for part in parts:
                for t, n in part["t"].value_counts().items():
                    if t >= passed:
                        pending[int(t)] = pending.get(int(t), 0) + int(n)
        ended = []
        for t in sorted(t for t in pending if t < passed):
            if start is None or t >= start + width:
                ended += [(start, count)] * (start is not None)
                start, count = t, 0
            count += pending.pop(t)
        if start is not None and start + width <= passed:
            ended.append((start, count))
            start, count = None, 0
        if start is None and not pending:
            if state.exists:
                state.remove()
        else:
            waiting = sorted(pending)
            state.update((start, count, waiting, [pending[t] for t in waiting]))
            wake = min([*(t + 1 for t in waiting[:1]), *([] if start is None else [start + width])])
            state.setTimeoutTimestamp(max(-(-wake // 1000), passed // 1000 + 1))
        yield pd.DataFrame({"client": pd.Series([key[0]] * len(ended), dtype="object"),
                            "start": pd.Series([s for s, _ in ended], dtype="int64"), "requests": pd.Series([n for _, n in ended], dtype="int64")})

    seen = (requests.withWatermark(at, late).filter(F.col(client).isNotNull() & F.col(at).isNotNull())
            .select(F.col(client).cast("string").alias("client"), F.unix_micros(at).alias("t"), F.col(at).alias("at")))
    counted = seen.groupBy("client").applyInPandasWithState(
        windows, "client string, start long, requests long", "start long, count long, times array<long>, counts array<long>",
        "append", GroupStateTimeout.EventTimeTimeout)
    return counted.select(F.col("client").cast(requests.schema[client].dataType).alias(client),
                          F.timestamp_micros("start").alias("window_start"), "requests")
