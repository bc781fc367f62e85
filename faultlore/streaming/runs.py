"""Drive a stream over the data that is there now."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def read_stream_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A Parquet table (file or folder) of ``folder`` as a stream."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # The last letter as a pattern, since a stream takes a file only by pattern.
    return spark.readStream.schema(schema).parquet(path[:-1] + "[t]")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Process all data there is into a Parquet table in ``folder`` and return that table.

    Sink and checkpoint lie in the folder, which all executors share, so a lost
    executor or driver costs at most the batch at hand.
    """
    spark = stream.sparkSession
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


@contextmanager
def partial_sessions(spark: SparkSession) -> Iterator[None]:
    """Streams started inside merge the sessions of a task's own rows before these are shuffled."""
    name = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
