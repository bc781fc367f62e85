"""Usage tables derived from ``events``, which stands in for request facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OWNERS = 20


def derived_usage(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("api_key_id"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 302)
        .otherwise(200).alias("status_code"),
        F.when(F.col("event_id") % 11 != 0, F.floor("value").cast("int")).alias("response_time_ms"),
        F.col("ts").alias("created_at"))


def derived_keys(events: DataFrame) -> DataFrame:
    """One key per user id; some are revoked or run out.  Owners have several."""
    uid = F.col("user_id")
    first = F.col("created_at")
    return (events.groupBy("user_id").agg(
                F.min("ts").alias("created_at"), F.max("ts").alias("last_used_at"))
            .select(
                uid.alias("id"),
                (uid % OWNERS).alias("user_id"),
                F.sha2(F.concat(F.lit("key-"), uid.cast("string")), 256).alias("key_hash"),
                F.substring(F.concat(F.lit("key-"), uid.cast("string")), 1, 11).alias("key_prefix"),
                F.concat(F.lit("Key "), uid.cast("string")).alias("name"),
                (uid % 7 != 0).alias("is_active"),
                first, F.col("last_used_at"),
                F.when(uid % 5 == 0, first + F.expr("INTERVAL 10 DAYS")).alias("expires_at")))


def derived_requests(events: DataFrame) -> DataFrame:
    """Requests with the key text they presented; some present an unknown one."""
    uid = F.col("user_id")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 13 == 0, F.lit("key-none"))
        .otherwise(F.concat(F.lit("key-"), uid.cast("string"))).alias("presented_key"),
        F.col("ts").alias("requested_at"))
