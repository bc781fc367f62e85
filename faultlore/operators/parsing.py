"""Parse raw log lines into metadata columns (row-wise, batch or stream)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlore.functions import metadata as md
from faultlore.functions.slices import SLICE, Slices
from faultlore.functions.text import apart, trimmed

METADATA_COLUMNS = (
    "timestamp", "log_level", "extracted_source", "pid", "error_code", "ip_address", "port",
    "username", "file_path", "http_status", "http_method", "url", "message_body",
)

# Keys of the metadata map, for a matched line and an unmatched one.
MATCHED_KEYS = {
    "logLevel": "log_level", "pid": "pid", "ipAddress": "ip_address", "port": "port",
    "errorCode": "error_code", "username": "username", "filePath": "file_path",
    "httpStatus": "http_status", "httpMethod": "http_method", "url": "url",
}
UNKNOWN_KEYS = ("logLevel", "errorCode", "ipAddress", "httpStatus")


def reject_empty_logs(logs: DataFrame) -> DataFrame:
    """A log line must be non-empty text; white space counts as text."""
    return logs.filter(F.col("raw_log") != "")


def parse_log_line(logs: DataFrame) -> DataFrame:
    """Adds the metadata columns of ``raw_log``; columns not used are never computed."""
    line, scan, stamp = F.col("_line"), F.col("_scan"), F.col("timestamp")
    return (logs
            .withColumn("_line", trimmed(F.col("raw_log")))
            .withColumn("timestamp", apart(md.extract_timestamp(line)))
            .withColumn("_scan", md.strip_timestamp(line, stamp))
            .withColumn("ip_address", apart(md.extract_ip(scan)))
            .withColumns({
                "log_level": apart(md.extract_log_level(scan)),
                "extracted_source": md.extract_source(scan),
                "pid": md.extract_pid(scan),
                "error_code": md.extract_error_code(scan),
                "port": md.extract_port(scan, F.col("ip_address")),
                "username": md.extract_username(scan),
                "file_path": md.extract_file_path(scan),
                "http_status": md.extract_http_status(scan),
                "http_method": md.extract_http_method(scan),
                "url": md.extract_url(scan),
                "message_body": md.message_body(line, stamp),
            })
            .drop("_line", "_scan"))


def metadata_map(matched: Column) -> Column:
    """Map of the fields present: ten keys for a matched line, four otherwise."""
    pairs = []
    for key, column in MATCHED_KEYS.items():
        value = F.col(column)
        pairs += [F.lit(key), value if key in UNKNOWN_KEYS else F.when(matched, value)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def event_time(timestamp: Column, default_year: int | Column, zone: str = "UTC") -> Column:
    """The time stamp text as a TIMESTAMP, NULL if it names no valid time.

    Syslog time has no year, so one must be given.  A stamp that names no zone is a time
    in ``zone``, whatever the session's.
    """
    squeezed = F.regexp_replace(timestamp, md.SPACE + "+", " ")
    digits = F.length(timestamp)
    epoch = timestamp.try_cast("bigint")
    year = default_year if isinstance(default_year, Column) else F.lit(default_year)
    zoned = F.when(timestamp.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), timestamp).otherwise(F.concat(timestamp, F.lit(f" {zone}")))
    return F.coalesce(
        F.when(timestamp.rlike(r"^\d{10}$"), F.timestamp_seconds(epoch)),
        F.when(timestamp.rlike(r"^\d{13}$") & (digits == 13), F.timestamp_millis(epoch)),
        F.when(timestamp.rlike(r"^\d{4}-"), zoned.try_cast("timestamp")),
        F.when(timestamp.rlike(r"^\d{2}/"),
               F.try_to_timestamp(squeezed, F.lit("dd/MMM/yyyy:HH:mm:ss xx"))),
        F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), squeezed, F.lit(f" {zone}")),
                           F.lit("yyyy MMM d HH:mm:ss VV")))


#: A step between two stamps without a year that is longer than this leads into another year.
HALF_YEAR = 183 * 86400


def with_event_time(lines: DataFrame, first_year: int, key: str | None = None, seq: str = "seq", zone: str = "UTC",
                    slices: int | None = None) -> DataFrame:
    """Adds ``event_time`` to ``lines`` (``timestamp``, ``seq``), stamps without a year included.

    Along ``seq``, of each ``key`` or of all lines, a step back of more than half a year
    means that a new year has begun, and a step ahead of more than half a year
    that a line of the old one came late.  The first line is of ``first_year``.
    A long sequence is cut into ranges of ``seq``: each counts its own steps, and what
    comes before is one stamp and one count per range.
    """
    kept, of = lines.columns, "_key"
    bare = F.when(~F.col("timestamp").rlike(r"^\d"), F.unix_timestamp(event_time(F.col("timestamp"), 2000, "UTC")))
    lines = lines.withColumns({of: F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit(""), "_at": bare})
    order = [F.col(seq)]
    ranges = Slices(lines, of, order, slices)
    before = Window.partitionBy(of, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(of, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def stepped(some: DataFrame, last: DataFrame) -> DataFrame:
        """Adds 1 where a year begins, -1 where one is gone back to."""
        some = ranges.with_carry(some.withColumn("_lag", F.last("_at", ignorenulls=True).over(before)), last,
                                 _carried=F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col(SLICE))))
        step = F.col("_at") - F.coalesce("_lag", "_carried")
        return some.withColumn("_step", F.when(step < -HALF_YEAR, 1).when(step > HALF_YEAR, -1).otherwise(0)).drop("_lag", "_carried")

    slim = ranges.cut_only(lines.select(of, "_at", F.col(seq)))
    last = slim.groupBy(of, SLICE).agg(F.max_by("_at", F.when(F.col("_at").isNotNull(), F.col(seq))).alias("_last"))
    steps = stepped(slim, last).groupBy(of, SLICE).agg(F.sum("_step").alias("_steps"))
    cut = stepped(ranges.cut(lines), last).withColumn("_own", F.sum("_step").over(upto))
    years = ranges.with_carry(cut, steps, _years=F.sum("_steps"))
    year = F.lit(first_year) + F.col("_own") + F.coalesce("_years", F.lit(0))
    return years.withColumn("event_time", event_time(F.col("timestamp"), year, zone)).select(*kept, "event_time")
