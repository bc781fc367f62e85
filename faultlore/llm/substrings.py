"""Repeated passages: a count-min prefilter before windows are grouped exactly.

1. Anchors.  A window of 35 words is represented by one of its runs of 16 words,
   the one with the smallest hash, so equal windows choose equal anchors and a
   text has about a tenth as many anchors as windows.  Each task sketches its
   anchors' counts; the sketches are merged cell by cell in slices of the cells.
   A cell counts every anchor that falls into it, so it overestimates an anchor's
   count, which in turn is at least the count of each of its windows: no window
   that occurs twice is lost.  Counts above two are kept as two.
2. Windows.  A second pass over the texts sends only windows whose anchor is
   estimated to occur twice; a grouped count finds which of them occur once.
   Windows that a batch holds twice are sent once.
3. Removal.  A third pass drops the windows found single and removes all words
   that the remaining ones cover.

What is broadcast is the merged sketch, ``2 ** cells_log2 * depth`` bits however
large the corpus is (32 MB by default).  A corpus with more anchors than cells
only makes the filter pass more windows to the exact count.

Windows are compared by 64-bit hashes of their words.

Edge cases.  Null, empty and short texts have no window: all words stay, and
``kept_sha256`` of no words is that of the empty string.  A repeated row repeats
all its windows, which are then removed from both.  Rows with a null ``doc_id``
take part like others.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlore.llm.common import column, slices, written
from faultlore.llm.words import mixed, runs, starts_of_runs, words

#: Cells of a slice of the sketch, which one group merges.
SLICE_LOG2 = 20
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the first smallest value of each run of ``width`` values."""
    # smallest of runs whose length doubles; two of them, overlapping, cover the width
    best, span = np.arange(len(values)), 1
    while 2 * span <= width:
        one, two = best[:-span], best[span:]
        best, span = np.where(values[two] < values[one], two, one), 2 * span
    rest = width - span
    if rest:
        one, two = best[:-rest], best[rest:]
        best = np.where(values[two] < values[one], two, one)
    return best


def anchors(hashes: np.ndarray, limits: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within a text, their anchors' positions, and the hashes of runs of ``anchor`` words."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = runs(hashes, anchor)
    starts = np.flatnonzero(starts_of_runs(limits, len(hashes), window))
    return starts, _first_smallest(grams, window - anchor + 1)[starts], grams


def _cells(grams: np.ndarray, cells_log2: int, depth: int) -> np.ndarray:
    """The cell of each run in each row of the sketch: (depth, n)."""
    shift = np.uint64(64 - cells_log2)
    return np.stack([mixed(grams + np.uint64(row + 1)) >> shift for row in range(depth)]).astype(np.int64)


def _sketched(docs: DataFrame, window: int, anchor: int, cells_log2: int, depth: int) -> DataFrame:
    """(row, slice, cells): the sorted cells of the merged sketch whose count is two or more, as 32-bit numbers."""
    low = min(SLICE_LOG2, cells_log2)

    def sketch(batches):
        for batch in batches:
            for _, data, offsets in slices(batch):
                _, _, hashes, limits = words(data, offsets)
                _, at, grams = anchors(hashes, limits, window, anchor)
                out: tuple[list, ...] = ([], [], [], [])
                if len(at):
                    for row, cells in enumerate(_cells(grams[np.unique(at)], cells_log2, depth)):
                        cells, counts = np.unique(cells, return_counts=True)
                        owner = cells >> low
                        cuts = np.flatnonzero(np.diff(owner)) + 1
                        for part, many in zip(np.split(cells, cuts), np.split(counts > 1, cuts)):
                            inside = (part & ((1 << low) - 1)).astype(np.uint32)
                            for value, item in zip((row, int(part[0] >> low), inside.tobytes(), inside[many].tobytes()), out):
                                item.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()),
                     pa.array(out[3], pa.binary())], names=["row", "slice", "seen", "twice"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros(1 << low, bool), np.zeros(1 << low, bool)
        for batch in batches:
            for own, many in zip(column(batch, "seen"), column(batch, "twice")):
                own = np.frombuffer(own.as_buffer(), np.uint32)
                twice[own[seen[own]]] = True
                seen[own] = True
                twice[np.frombuffer(many.as_buffer(), np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
                                          pa.array([np.packbits(twice).tobytes()], pa.binary())],
                                         names=["row", "slice", "bits"])

    return (docs.select("text").mapInArrow(sketch, "row int, slice int, seen binary, twice binary")
            .groupBy("row", "slice").applyInArrow(merge, "row int, slice int, bits binary"))


def repeated_windows_removed(docs: DataFrame, window: int = 35, anchor: int = 16, cells_log2: int = 27,
                             depth: int = 2, text_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of ``docs`` (doc_id, text).

    Every word covered by a window of ``window`` words that also starts anywhere
    else is removed.  With ``text_out`` a column ``text`` holds the kept words.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    low = min(SLICE_LOG2, cells_log2)
    bits = np.zeros((depth, (1 << cells_log2) // 8), np.uint8)
    for row in _sketched(docs, window, anchor, cells_log2, depth).collect():
        size = (1 << low) // 8
        bits[row["row"], row["slice"] * size:(row["slice"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    sketch = spark.sparkContext.broadcast(bits.tobytes())

    def suspected(hashes: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor is estimated to occur twice."""
        starts, at, grams = anchors(hashes, limits, window, anchor)
        if not len(at):
            return starts
        own, of = np.unique(at, return_inverse=True)
        table = np.frombuffer(sketch.value, np.uint8).reshape(depth, -1)
        hit = np.ones(len(own), bool)
        for row, cells in enumerate(_cells(grams[own], cells_log2, depth)):
            hit &= (table[row, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        return starts[hit[of]]

    def send(batches):
        for batch in batches:
            for part, data, offsets in slices(batch):
                _, _, hashes, limits = words(data, offsets)
                starts = suspected(hashes, limits)
                own, first, counts = np.unique(runs(hashes, window)[starts] if len(starts) else hashes[:0],
                                               return_index=True, return_counts=True)
                starts = starts[first] if len(starts) else starts
                row = np.searchsorted(limits, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.view(np.int64)), pa.array(counts.astype(np.int64)),
                     column(part, "doc_id").cast(pa.int64()).take(pa.array(row)), column(part, "crc").take(pa.array(row)),
                     pa.array((starts - limits[row]).astype(np.int32))], names=["window", "n", "doc_id", "crc", "at"])

    keyed = docs.withColumn("crc", F.xxhash64("text"))
    sent = keyed.mapInArrow(send, "window long, n long, doc_id long, crc long, at int")
    single = (sent.groupBy("window").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("crc").alias("crc"),
                                         F.min("at").alias("at")).filter("n = 1"))
    single = single.groupBy("doc_id", "crc").agg(F.collect_list("at").alias("single"))

    def remove(batches):
        for batch in batches:
            for part, data, offsets in slices(batch):
                begin, end, hashes, limits = words(data, offsets)
                starts = suspected(hashes, limits)
                row = np.searchsorted(limits, starts, "right") - 1
                own = column(part, "single")
                bounds = np.searchsorted(row, np.arange(len(part) + 1))
                whole = data.tobytes()
                removed, digests, rest = [], [], []
                for i in range(len(part)):
                    low, high = limits[i], limits[i + 1]
                    at = starts[bounds[i]:bounds[i + 1]] - low
                    if own[i].is_valid:
                        at = np.setdiff1d(at, own[i].values.to_numpy())
                    depth_at = np.zeros(high - low + 1, np.int32)
                    np.add.at(depth_at, at, 1), np.add.at(depth_at, at + window, -1)
                    stay = np.flatnonzero(np.cumsum(depth_at[:-1]) == 0) + low
                    kept = b" ".join([whole[a:b] for a, b in zip(begin[stay].tolist(), end[stay].tolist())])
                    removed.append(int(high - low - len(stay)))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if text_out:
                        rest.append(kept.decode())
                more = ([pa.array(rest, pa.string())], ["text"]) if text_out else ([], [])
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id").cast(pa.int64()), pa.array(np.diff(limits).astype(np.int64)),
                     pa.array(removed, pa.int64()), pa.array(digests, pa.string()), *more[0]],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", *more[1]])

    of = single.select(F.col("doc_id").alias("of"), F.col("crc").alias("of_crc"), "single")
    met = keyed.join(of, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("crc") == F.col("of_crc")), "left")
    return met.select("doc_id", "text", "single").mapInArrow(remove, RESULT + (", text string" if text_out else ""))
