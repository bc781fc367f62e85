"""Exact duplicates by an extendible-hash index on shared files.

1. Every row gets a slot: its id, the 64-bit hash of its normalised text (the key)
   and the text's SHA-256.  Slots are written once, without texts.
2. The directory starts with one bucket for all keys and doubles as long as a
   bucket holds more than ``capacity`` distinct keys: an overfull bucket splits by
   its next bit.  It has at most ``2 ** DEEPEST`` entries, however large the corpus.
3. Owner tasks take the buckets' key ranges.  Rows of equal keys are chained by
   comparing the bytes of their texts, each chain link holding one text's smallest
   id and number of rows.  Copies within a task become one before they are
   shuffled, so a text that a third of all rows share is one row per task.  The
   index is written to shared files without texts.
4. Each slot finds its link by bucket, key and SHA-256.

Edge cases.  Null counts as empty, so null and empty texts are equal; texts of white
space equal one space.  A null ``doc_id`` is never the smallest unless its whole
group has none; it is kept only then.  Repeated rows are equal to each other.  With
keys of rows (``row``) one row of each group is kept, of those with the
smallest id the one with the smallest key; without, as in the SQL, all rows that
have the smallest id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlore.llm.common import written

#: Distinct keys of a bucket; bits of the deepest directory.
CAPACITY, DEEPEST = 100_000, 14


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _entry(key: Column) -> Column:
    """The first ``DEEPEST`` bits of a key of 64."""
    return F.shiftrightunsigned(key, 64 - DEEPEST)


def directory(keys: DataFrame, capacity: int = CAPACITY, store: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(entry, bucket) for each ``DEEPEST``-bit prefix that occurs.

    A bucket of depth d is named 2 ** d + its d bits.  ``keys`` has the distinct
    keys.  What the rounds work on are counts by prefix, 2 ** DEEPEST rows at most.
    """
    counts = keys.groupBy(_entry(F.col("key")).alias("entry")).agg(F.count("*").alias("n"))
    of = store(counts.withColumn("bucket", F.shiftright("entry", DEEPEST) + 1), "directory")
    for depth in range(1, DEEPEST + 1):
        full = (of.filter(F.col("bucket") >= 1 << (depth - 1)).groupBy("bucket").agg(F.sum("n").alias("size"))
                .filter(F.col("size") > capacity).select("bucket", F.lit(True).alias("full")))
        if full.isEmpty():
            break
        half = F.shiftright("entry", DEEPEST - depth) + (1 << depth)
        split = of.join(F.broadcast(full), "bucket", "left")
        of = store(split.select("entry", "n", F.when(F.col("full"), half).otherwise(F.col("bucket")).alias("bucket")),
                   "directory")
    return of.select("entry", "bucket")


def slots(docs: DataFrame) -> DataFrame:
    text = normalised(F.col("text"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", *rest, F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("text_sha256"))


def index(docs: DataFrame, of: DataFrame) -> DataFrame:
    """(bucket, key, link, text_sha256, keep_id, group_size): one row per distinct text."""
    own = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    own = own.withColumn("key", F.xxhash64("text")).withColumn("entry", _entry(F.col("key")))
    own = own.join(F.broadcast(of), "entry")
    links = (own.groupBy("bucket", "key", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
             .withColumn("text_sha256", F.sha2("text", 256)).drop("text"))
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    return links.withColumn("link", F.row_number().over(chain))


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, row: str | None = None,
                     store: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of ``docs`` (doc_id, text).

    ``row`` names a column with a key of each row, which the result has too; then
    exactly one row of each group is kept.  ``store`` stores the index, from which the
    result is read.
    """
    docs = docs.select("doc_id", "text", *([F.col(row).alias("row")] if row else []))
    own = store(slots(docs), "slots")
    of = directory(own.select("key").distinct(), capacity, store)
    links = store(index(docs, of), "index")
    found = own.join(links.select("key", "text_sha256", "keep_id", "group_size"), ["key", "text_sha256"])
    smallest = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not row:
        return found.select("doc_id", "keep_id", "group_size", smallest.alias("kept"), "text_sha256")
    # the keys of equal rows meet as one partial minimum a task
    first = found.filter(smallest).groupBy("key", "text_sha256").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    return found.join(first, "row", "left").select(
        F.col("row").alias(row), "doc_id", "keep_id", "group_size", F.coalesce("first", F.lit(False)).alias("kept"), "text_sha256")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
