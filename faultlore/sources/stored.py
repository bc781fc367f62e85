"""Tables that are kept up to date partition by partition.

A write replaces the partitions it has rows for and leaves all others, files
included, as they are.  So a repeated write leaves what one write leaves.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Write ``df``, replacing the partitions that occur in it."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))


def stored_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or one without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def bucket_of(key: str, buckets: int):
    """The partition of a key among ``buckets``."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def values_of(df: DataFrame, column: str) -> list:
    """The distinct values of a partition column: few by the nature of partitions."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def stored_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own in ``spark.checkpoint.dir``, for what reads it several times; as it is where none is set.

    The folder belongs to the job, whose owner removes it with the job.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
