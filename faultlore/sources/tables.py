"""Read and write the tables of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlore.functions.text import utc_day

#: Splits whose counts may be broadcast: a row each, of a path and two numbers.
FEW_SPLITS = 100_000
RAW_LOGS_DDL = "log_id bigint, seq bigint, incident_id string, raw_log string, source string"


def read_raw_logs(spark: SparkSession, path: str, fmt: str = "text", source: str | None = None,
                  line_column: str = "raw_log", line_sep: str | None = None) -> DataFrame:
    """Log lines from text (one per line), JSON or Parquet as ``log_id, seq, raw_log, source``.

    Files with a ``log_id`` column keep it as it is, null where a row has none.
    Other files get one from 0, without gaps: files by path, lines by place in the
    file.  ``seq`` is the given one, or else ``log_id``.  Lines of text end at line feeds and
    carriage returns, or at ``line_sep`` alone.
    """
    if fmt == "text":
        logs = spark.read.text(path, lineSep=line_sep)
    elif fmt == "json":
        given = set(spark.read.json(path).columns)
        ddl = [f for f in RAW_LOGS_DDL.replace("raw_log string", f"`{line_column}` string").split(", ")
               if f.split()[0].strip("`") in given]
        logs = spark.read.schema(", ".join(ddl)).json(path)
    else:
        logs = spark.read.format(fmt).load(path)
    columns = {"raw_log" if c == line_column or (fmt == "text" and c == "value") else c for c in logs.columns}
    if "log_id" not in columns:
        logs = _numbered(logs)
    line = "value" if fmt == "text" else line_column
    if line != "raw_log" and line in logs.columns:
        logs = logs.withColumnRenamed(line, "raw_log")
    logs = logs.withColumn("seq", F.coalesce("seq", "log_id") if "seq" in columns else F.col("log_id"))
    if source is not None or "source" not in columns:
        logs = logs.withColumn("source", F.lit(source).cast("string"))
    kept = [c for c in ("incident_id",) if c in columns]
    return logs.select("log_id", "seq", *kept, "raw_log", "source")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of files with ``log_id``: by path, then by place in the file, from 0.

    Rows are counted per split of a file; a split starts at the number of rows in
    the splits before it.  Only one row per split is sorted, and as long as there are no
    more than ``FEW_SPLITS`` of them, they are sent to the rows, which stay where they are.
    """
    most = len(rows.inputFiles()) + rows.rdd.getNumPartitions()
    split = {"_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
             "_id": F.monotonically_increasing_id()}
    placed = rows.withColumns(split)
    splits = placed.groupBy("_path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    by_path = splits.groupBy("_path").agg(F.sum("_n").alias("_all"))
    paths = by_path.select("_path", (F.sum("_all").over(Window.orderBy("_path")) - F.col("_all")).alias("_files_before"))
    in_path = F.sum("_n").over(Window.partitionBy("_path").orderBy("_start")) - F.col("_n")
    starts = splits.withColumn("_before", in_path).join(paths, "_path").select(
        "_path", "_start", "_first", (F.col("_before") + F.col("_files_before")).alias("_before"))
    return (placed.join(F.broadcast(starts) if most <= FEW_SPLITS else starts, ["_path", "_start"])
            .withColumn("log_id", F.col("_id") - F.col("_first") + F.col("_before"))
            .drop("_path", "_start", "_id", "_first", "_before"))


def split_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per line of a text column, numbered by ``seq`` from 0."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("seq", "raw_log"))


def explode_batch(df: DataFrame, logs: str, *keys: str) -> DataFrame:
    """One row per element of an array column of lines, numbered by ``seq`` from 0."""
    return df.select(*keys, F.posexplode(logs).alias("seq", "raw_log"))


def read_usage(spark: SparkSession, path: str, since: Column | None = None,
               fmt: str = "parquet", newest_first: bool = False) -> DataFrame:
    """Request facts; ``since`` is pushed down to the scan, ``newest_first`` sorts all of them."""
    usage = spark.read.format(fmt).load(path)
    if since is not None:
        usage = usage.filter(F.col("created_at") >= since)
    return usage.orderBy(F.desc("created_at")) if newest_first else usage


def read_keys(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def append_usage(usage: DataFrame, path: str) -> None:
    """Append request facts, one folder per day (UTC) so that reports read only their days."""
    (usage.withColumn("day", utc_day(usage, "created_at"))
     .write.mode("append").partitionBy("day").parquet(path))


def write_explanations(explained: DataFrame, path: str, fmt: str = "parquet",
                       mode: str = "errorifexists") -> None:
    explained.write.format(fmt).mode(mode).save(path)


def explanations_json(explained: DataFrame) -> DataFrame:
    """Each explanation as one JSON text."""
    return explained.select(F.to_json(F.struct("*")).alias("explanation"))
