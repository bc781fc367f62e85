"""Sets of shingles of texts: their hashes, and exact comparison by their words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlore.llm.common import column
from faultlore.llm.words import mixed, runs

_LOWER = bytes([i + 32 if 65 <= i <= 90 else i for i in range(256)])


def shingle_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Distinct shingle hashes of one text's word hashes, ascending; the whole sequence if it is shorter than a shingle."""
    if len(hashes) == 0:
        return hashes
    if len(hashes) < length:
        return mixed(runs(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(runs(hashes, length))


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def shingle_set(text: str, length: int) -> set[tuple[bytes, ...]]:
    """The shingles of a text as tuples of lower-case words."""
    own = text.encode().translate(_LOWER).split()
    return set(zip(*(own[i:] for i in range(length)))) if len(own) >= length else {tuple(own)}


def similar(one: set, two: set, percent: int) -> bool:
    both = len(one & two)
    return 100 * both >= percent * (len(one) + len(two) - both)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets reach the similarity, from the words of both ``texts`` (sid, text)."""
    def verify(batches):
        known: tuple[str, set] = "", set()
        for batch in batches:
            keep = []
            for one, two in zip(column(batch, "one"), column(batch, "two")):
                one, two = one.as_py(), two.as_py()
                if two != known[0]:
                    known = two, shingle_set(two, shingle)
                keep.append(similar(shingle_set(one, shingle), known[1], percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("sid").alias("a"), F.col("text").alias("one"))
    two = texts.select(F.col("sid").alias("b"), F.col("text").alias("two"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    return both.select("a", "b", "one", "two").mapInArrow(verify, "a long, b long")
