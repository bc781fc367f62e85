"""The folder in which the queries write the tables they read back."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, for checkpoints and written tables.

    Clusters name it in ``spark.checkpoint.dir``.  Only a local session may do
    without and gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="faultlore-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
