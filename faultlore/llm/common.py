"""Tables in the shared folder, and Arrow helpers of the operators.

Every operator first selects the columns it uses, so further columns of the
input, whatever their names, neither clash nor travel through a shuffle.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once in a Python worker, in bytes; bounds its memory.
SLICE_BYTES = 4 << 20
#: Rows sent to a Python worker at once while a table is stored.
BATCH = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; an own one only where it is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="faultlore-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    The folder belongs to the job, whose owner removes it with the job: the
    returned DataFrame and all that is derived from it read the table lazily.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends ``BATCH`` rows to a Python worker at once, so that rows with two texts take little memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables that an operator stores for its own use, and removes once its result is stored."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{name}-{self.tables}"
        with _small_batches(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _place() -> Column:
    """A row's place in the files of a table, as a key of 24 bytes: its file's digest and its number in the file."""
    return F.unhex(F.concat(F.md5("_metadata.file_path"), F.lpad(F.hex("_metadata.row_index"), 16, "0")))


def placed(docs: DataFrame, *columns: str, name: str = "row", store: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """``columns`` of ``docs`` and ``name``, a key of its own for each row that stays the same whenever it is read.

    A scan of Parquet files is read where it is; other DataFrames are stored first.
    """
    own = docs.select(*columns)
    try:
        return own.select(*columns, _place().alias(name))
    except AnalysisException:
        return store(own, "rows").select(*columns, _place().alias(name))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many lines below as it takes to differ from the columns of ``docs``."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def sent(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df``, a stored table of slim rows, marked to be broadcast if it is counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large strings, null as empty."""
    return pc.fill_null(column(batch, name).cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, name: str = "text",
           most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their bytes of text (UTF-8) and the rows' offsets in those.

    A run has at most ``most`` bytes, or one row.
    """
    text = texts(batch, name)
    _, offsets, data = text.buffers()
    if len(text) == 0:
        return
    offsets = np.frombuffer(offsets, np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield batch.slice(low, high - low), data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high
