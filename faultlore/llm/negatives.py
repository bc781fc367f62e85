"""Hard-negative mining by a secondary sort.

1. Vectors become integers and are dealt into blocks; every block of anchors meets
   every block of rows, so a stated set of anchors is scored against all rows in
   groups of bounded size.  Scores are exact integers.
2. A group keeps, of each anchor, its first ``positives`` rows of the anchor's label:
   no other can be a positive.  Score, anchor and id are packed into one key, anchors
   are dealt to tasks by repartition, sorted within partitions by the key (anchor,
   descending score, id), and an iterator over the sorted rows opens a window for
   each of an anchor's first positives.
3. Groups meet once more: of each window, a group keeps its first ``negatives`` rows
   of other labels, as no other can be returned.
4. Positives and negatives go through the same secondary sort.  The iterator opens a
   window when a positive passes and emits each negative that falls into an open one.
   It holds the open windows and the first negatives of the present score, never an
   anchor's rows.

repartition and sortWithinPartitions are the DataFrame form of
repartitionAndSortWithinPartitions: one shuffle by anchor, one sort by the packed key.

Edge cases.  Rows with a null label, a null vector, or a null or non-finite component
take no part.  Components saturate at 64 bits, as do scores.  Vectors of different
lengths have no score.  A row with a null id is no anchor; among equal scores it comes
last.  Repeated rows are rows of their own: an anchor's copy is another row, and
repeated anchors have results of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlore.llm.common import Scratch, column, written

#: Rows and anchors of a block; anchors scored at once.
ROWS, ANCHORS, AT_ONCE = 4096, 8192, 128
#: Scores below this bound are exact as doubles, and with a place in a block as 64-bit numbers.
EXACT = 1 << 49
LARGEST = (1 << 63) - 1
RECORD = "anchor long, anchor_id long, key binary, score long, id long, row long, positive boolean"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(vectors: DataFrame, every: int, scale: int) -> DataFrame:
    """row, id, label, anchor and integer values of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    own = vectors.filter("label IS NOT NULL AND embedding IS NOT NULL").filter(~odd)
    return own.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"),
                      F.col("label").cast("string").alias("label"),
                      F.coalesce(F.col("vec_id") % every == 0, F.lit(False)).alias("anchor"),
                      F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("values"))


def _key(anchor: int, score: int, vec_id: int | None, row: int) -> bytes:
    """Keys order by anchor, descending score, id (null last) and row."""
    sign = 1 << 63
    return struct.pack(">QQ?QQ", anchor + sign, sign - score, vec_id is None, (vec_id or 0) + sign, row + sign)


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """The smallest and largest score s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


class _Block:
    """Rows of a block by (id, row), null ids last, and anchors, for one length of vectors."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
        self.anchors, self.rows = anchors, rows
        self.anchor_row, self.row = anchors["row"].to_numpy(), rows["row"].to_numpy()
        self.anchor_id, self.id = anchors["id"].to_pylist(), rows["id"].to_pylist()
        _, codes = np.unique(np.array(anchors["label"].to_pylist() + rows["label"].to_pylist(), dtype=object).astype(str),
                             return_inverse=True)
        self.anchor_label, self.label = codes[:len(anchors)], codes[len(anchors):]
        one, two = (t["values"].combine_chunks().flatten().to_numpy().reshape(len(t), -1) for t in (anchors, rows))
        most = max((max(int(x.max()), -int(x.min())) for x in (one, two) if x.size), default=0)
        self.exact = one.shape[1] * most * most < EXACT
        self.one, self.two = (one.astype(float), two.astype(float)) if self.exact else (one.astype(object), two.astype(object))

    def scores(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each anchor's place and its scores, as integers."""
        for low in range(0, len(self.one), AT_ONCE):
            part = self.one[low:low + AT_ONCE] @ self.two.T if self.one.shape[1] else np.zeros((len(self.one[low:low + AT_ONCE]), len(self.two)))
            for i, own in enumerate(part.astype(np.int64) if self.exact else np.clip(part, -LARGEST, LARGEST)):
                yield low + i, own

    def first(self, own: np.ndarray, places: np.ndarray, most: int) -> list[int]:
        """The first ``most`` of ``places`` by descending score, then by place."""
        if not self.exact:
            return sorted(places.tolist(), key=lambda j: (-own[j], j))[:most]
        if len(places) > 4 * most:  # place and score in one number, so that no two are equal
            packed = own[places] * len(own) - places
            places = places[np.argpartition(packed, len(packed) - most)[len(packed) - most:]]
        return places[np.lexsort((places, -own[places]))][:most].tolist()


def _blocks(anchors: pa.Table, rows: pa.Table) -> Iterator[_Block]:
    lengths = [np.array([len(v) for v in t["values"]]) for t in (anchors, rows)]
    for length in np.intersect1d(*lengths):
        yield _Block(*(t.take(pa.array(np.flatnonzero(n == length))) for t, n in zip((anchors, rows), lengths)))


def _records(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    columns = list(zip(*rows)) or [[]] * len(kinds)
    names = [f.split()[0] for f in RECORD.split(", ")]
    return pa.table({name: pa.array(list(v), kind) for name, v, kind in zip(names, columns, kinds)})


def _record(block: _Block, i: int, j: int, own: np.ndarray, positive: bool) -> tuple:
    anchor, score, vec_id, row = int(block.anchor_row[i]), int(own[j]), block.id[j], int(block.row[j])
    return anchor, block.anchor_id[i], _key(anchor, score, vec_id, row), score, vec_id, row, positive


def _by_anchor(records: DataFrame) -> DataFrame:
    """The secondary sort: an anchor's rows in one partition, by descending score and id."""
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartition(tasks, "anchor").sortWithinPartitions("key")


class _Windows:
    """The open windows of the anchor that passes."""

    def __init__(self, positives: int, negatives: int, low: int, high: int):
        self.positives, self.negatives, self.low, self.high = positives, negatives, low, high
        self.anchor, self.open, self.level, self.at = None, [], [], None

    def take(self, anchor, score, vec_id, positive) -> Iterator[tuple]:
        """Results (positive_id, rank, negative_id, positive_score, negative_score) that a row completes."""
        if anchor != self.anchor:
            self.anchor, self.open, self.at = anchor, [], None
        if score != self.at:
            self.at, self.level = score, []
        if not positive:
            if len(self.level) < self.negatives:
                self.level.append(vec_id)
            for window in self.open:
                yield from self._fall(window, score, vec_id)
        elif len(self.open) < self.positives:
            window = [vec_id, score, *_window(score, self.low, self.high), 0]
            self.open.append(window)
            for earlier in self.level:  # of the same score, with smaller ids
                yield from self._fall(window, score, earlier)

    def _fall(self, window: list, score: int, vec_id) -> Iterator[tuple]:
        positive_id, positive_score, least, most, n = window
        if n < self.negatives and least <= score <= most:
            window[4] += 1
            yield positive_id, window[4], vec_id, positive_score, score


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: int = 256, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, from ``vectors`` (vec_id, label, embedding).

    Anchors are the rows whose id is divisible by ``every``.  A positive's negatives
    are the first rows of other labels whose score is ``low`` to ``high`` per cent of
    the positive's.  ``rows`` and ``anchors`` are the sizes of blocks.
    """
    store = Scratch(vectors.sparkSession, "negatives")
    own = store(quantised(vectors, every, scale), "vectors")
    of = store(own.filter("anchor").select("row", "id", "label", "values"), "anchors")
    across, down = (max(1, -(-t.count() // most)) for t, most in ((of, anchors), (own, rows)))
    dealt = (own.select("row", "id", "label", "values", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("a"))
             .withColumn("r", F.pmod(F.xxhash64("row"), F.lit(down)).cast("int")))

    def blocked(some: DataFrame) -> DataFrame:
        return (some.withColumn("a", F.pmod(F.xxhash64("row"), F.lit(across)).cast("int"))
                .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))))

    def nearest(one: pa.Table, two: pa.Table) -> pa.Table:
        out = []
        for block in _blocks(one, two) if len(one) and len(two) else ():
            for i, scores in block.scores():
                same = np.flatnonzero((block.label == block.anchor_label[i]) & (block.row != block.anchor_row[i]))
                out.extend(_record(block, i, j, scores, True) for j in block.first(scores, same, positives))
        return _records(out)

    def between(one: pa.Table, two: pa.Table) -> pa.Table:
        out = []
        for block in _blocks(one, two) if len(one) and len(two) else ():
            scored = block.anchors["scores"].to_pylist()
            for i, scores in block.scores():
                other, found = block.label != block.anchor_label[i], set()
                for score in set(scored[i]):
                    least, most = _window(score, low, high)
                    if least <= most:
                        inside = np.flatnonzero(other & (scores >= least) & (scores <= most))
                        found.update(block.first(scores, inside, negatives))
                out.extend(_record(block, i, j, scores, False) for j in sorted(found))
        return _records(out)

    def opened(batches):
        anchor, n = None, 0
        for batch in batches:
            keep = []
            for this in column(batch, "anchor").to_pylist():
                anchor, n = this, n + 1 if this == anchor else 1
                keep.append(n <= positives)
            yield batch.filter(pa.array(keep, pa.bool_()))

    def emitted(batches):
        windows = _Windows(positives, negatives, low, high)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in FOUND.split(", ")]
        for batch in batches:
            out = []
            for row in zip(*(column(batch, c).to_pylist() for c in ("anchor", "anchor_id", "score", "id", "positive"))):
                out.extend((row[1], *found) for found in windows.take(row[0], *row[2:]))
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(columns, kinds)], names=names)

    meet = blocked(of).groupBy("a", "r").cogroup(dealt.groupBy("a", "r"))
    best = store(_by_anchor(meet.applyInArrow(nearest, RECORD)).mapInArrow(opened, RECORD), "positives")
    windows = best.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("scores"))
    meet = blocked(of.join(windows, "row")).groupBy("a", "r").cogroup(dealt.groupBy("a", "r"))
    records = meet.applyInArrow(between, RECORD).unionByName(best)
    out = written(_by_anchor(records).mapInArrow(emitted, FOUND), "negatives")
    store.remove()
    return out


SQL = r"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS a, a.vec_id AS anchor_id, b.row AS b, b.vec_id AS id, a.label = b.label AS same,
             list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row <> b.row AND len(a.e) = len(b.e)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id NULLS LAST, s.b) AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
