"""Near-duplicate documents: banded MinHash and sequential Bayesian verification.

1. Each document's set of shingles is hashed and signed once; equal sets become
   one.  Signatures are cut into bands, and every band's bucket links its members
   to one of them, the pivot: as many candidates as members.
2. Candidates compare their signatures batch by batch.  After each batch, the
   posterior of the similarity (uniform prior) drops a candidate whose chance to
   reach the threshold is below ``miss``.
3. Survivors are verified on the words of both texts: first the likeliest of each
   set, then those that still join two components.
4. Buckets of three or more that still hold several components are compared in
   full across these, in blocks of bounded size, by the same Bayesian test; members
   with a likely partner then by their texts.  So a bucket costs its square only where its members are not
   linked, and a block returns fewer links than it has members.

At similarity 0.85 a pair shares no band with a chance of 7e-8 and is pruned
with a chance of about ``miss`` per batch.

Edge cases.  Null, empty and blank texts have an empty set: 0 shingles, linked
with nothing, each its own component and kept.  Repeated rows have equal sets and
so one component.  A row whose ``doc_id`` is null has the component of its set,
null if no row of the component has an id.  Kept are the rows whose id names their
component, also if it is null.  With keys of rows (``row``) exactly one row of each
component with words is kept: of those with the smallest id, or of all where none
has an id, the one with the smallest key.  An empty table gives an empty result.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlore.llm.common import Scratch, column, placed, sent, slices, written
from faultlore.llm.graph import components
from faultlore.llm.shingles import set_key, shingle_hashes, shingle_set, similar, verified
from faultlore.llm.words import mixed, runs, words

BANDS, ROWS = 28, 5
#: Rows and bytes of text of a block in the comparison of what is left of a bucket.
BLOCK, BLOCK_BYTES = 512, 8 << 20
SIGNED = "row binary, doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>"

_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), 1024):
        np.minimum(out, (shingles[low:low + 1024, None] * _FACTORS).min(0), out=out)
    return out


def signed(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """row, doc_id, size and key of each document's shingle set, its signature and its bands."""
    def sign(batches):
        for batch in batches:
            for part, data, offsets in slices(batch):
                _, _, hashes, limits = words(data, offsets, lower=True)
                sizes, keys, signatures, bands = [], [], [], []
                for low, high in zip(limits[:-1], limits[1:]):
                    own = shingle_hashes(hashes[low:high], shingle)
                    sizes.append(len(own))
                    if not len(own):
                        keys.append(None), signatures.append(None), bands.append(None)
                        continue
                    keys.append(set_key(own))
                    least = mixed(_minima(own))
                    signatures.append(least.astype(np.uint16).tobytes())
                    by_band = runs(least, ROWS)[::ROWS] + np.arange(BANDS, dtype=np.uint64)
                    bands.append(mixed(by_band).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "row").cast(pa.binary()), column(part, "doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "n_shingles", "set_key", "signature", "bands"])

    return docs.select("row", "doc_id", "text").mapInArrow(sign, SIGNED)


def least_matches(similarity: float, miss: float, compared: int) -> int:
    """The fewest matches of ``compared`` values at which P(similarity >= threshold) is still ``miss``.

    The posterior of m matches is Beta(m + 1, compared - m + 1), whose tail is
    P(Binomial(compared + 1, similarity) <= m).
    """
    tail, n = 0.0, compared + 1
    for m in range(n):
        tail += comb(n, m) * similarity ** m * (1 - similarity) ** (n - m)
        if tail >= miss:
            return m
    return compared


def _rounds(similarity: float, miss: float) -> list[tuple[int, int]]:
    return [(k, least_matches(similarity, miss, k)) for k in range(BANDS, BANDS * ROWS + 1, BANDS)]


def _signatures(of: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(of.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def _survivors(pairs: DataFrame, similarity: float, miss: float) -> DataFrame:
    """(a, b, matches) of the pairs that no batch of their signatures drops."""
    rounds = _rounds(similarity, miss)

    def compare(batches):
        for batch in batches:
            one, two = _signatures(column(batch, "one")), _signatures(column(batch, "two"))
            alive, matches, at = np.arange(len(one)), np.zeros(len(one), np.int64), 0
            for k, least in rounds:
                matches[alive] += (one[alive, at:k] == two[alive, at:k]).sum(1)
                alive, at = alive[matches[alive] >= least], k
            kept = batch.select(["a", "b"]).take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(matches[alive])], names=["a", "b", "matches"])

    return pairs.select("a", "b", "one", "two").mapInArrow(compare, "a long, b long, matches long")


def _meeting(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """``members`` once for every two blocks of their bucket that meet: low, high and the own block."""
    return (members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))


class _Group:
    """Two blocks of a bucket: whom a member may be linked with, by signature, label and earlier bands."""

    def __init__(self, table: pa.Table, rounds: list[tuple[int, int]]):
        self.rounds, self.values = rounds, _signatures(table["signature"].combine_chunks())
        self.sid, self.label, self.block = (table[c].to_numpy().copy() for c in ("sid", "component", "block"))
        self.low, self.high, band = (table[c][0].as_py() for c in ("low", "high", "band"))
        self.bands = np.array(table["bands"].to_pylist())[:, :band]

    def likely(self, i: int) -> np.ndarray:
        """Members in other components, the likeliest first."""
        rest = np.flatnonzero((self.label != self.label[i]) & (self.block == self.high)
                              & ((self.low != self.high) | (self.sid > self.sid[i])))
        rest = rest[~(self.bands[rest] == self.bands[i]).any(1)]
        matches, at = np.zeros(len(rest), np.int64), 0
        for k, least in self.rounds:
            matches += (self.values[rest, at:k] == self.values[i, at:k]).sum(1)
            rest, matches, at = rest[matches >= least], matches[matches >= least], k
        return rest[np.argsort(-matches, kind="stable")]


def _across(members: DataFrame, sets: DataFrame, texts_of, percent: int, shingle: int, miss: float, store: Scratch) -> DataFrame:
    """Links (a, b) between different components of a bucket: (key, band, n, sid, component).

    Members are dealt into blocks of about ``BLOCK`` and every two blocks meet in a
    group of bounded size.  The first time, without texts, groups find the members
    with a likely partner: sharing no earlier band, linked by nothing yet, alike by
    signature.  Only these get their texts and meet again, in blocks bounded by
    bytes too.  A group returns fewer links than it has members.
    """
    rounds = _rounds(percent / 100, miss)
    own = members.join(sets.select("sid", "signature", "bands"), "sid").select("key", "sid", "component", "band", "signature", "bands", "n")
    own = store(own, "members")

    def alive(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group, found = _Group(table, rounds), set()
        for i in np.flatnonzero(group.block == group.low):
            others = group.likely(i)
            if len(others):
                found.update((int(i), *others.tolist()))
        return table.select(["key", "sid"]).take(pa.array(sorted(found), pa.int64()))

    blocks = own.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")).distinct()
    likely = store(_meeting(own, blocks).groupBy("key", "low", "high").applyInArrow(alive, "key long, sid long").distinct(), "likely")
    own = own.join(likely, ["key", "sid"]).join(texts_of(likely.select("sid").distinct()), "sid")
    own = store(own.withColumn("bytes", F.octet_length("text")), "texts")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group = _Group(table, rounds)
        known: dict[int, set] = {}

        def words_of(i: int) -> set:
            if i not in known:
                known[i] = shingle_set(table["text"][i].as_py(), shingle)
            return known[i]

        links, label = [], group.label
        for i in np.flatnonzero(group.block == group.low):
            for j in group.likely(i):
                if label[i] != label[j] and similar(words_of(int(i)), words_of(int(j)), percent):
                    links.append((group.sid[i], group.sid[j]))
                    label[label == label[j]] = label[i]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = own.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    return _meeting(own, blocks).groupBy("key", "low", "high").applyInArrow(compare, "a long, b long")


def _least() -> Column:
    """The row with the smallest id, null last, and of these the smallest number."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 3, miss: float = 1e-6, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Rows are linked where 100 * |intersection| >= percent * |union| of their
    sets of ``shingle`` words; the component is named by its smallest doc_id.
    ``row`` names a column with a key of each row, which the result has too; then one
    row of each component is kept, else all that have its smallest id.
    """
    similarity, spark = percent / 100, docs.sparkSession
    store = Scratch(spark, "near")
    docs = docs.select(F.col(row).alias("row"), "doc_id", "text") if row else placed(docs, "doc_id", "text", store=store)
    rows = store(signed(docs, shingle), "signed")
    sets = (rows.filter("set_key IS NOT NULL").groupBy("set_key")
            .agg(_least(), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
            .select("set_key", "least.doc_id", "least.row", "signature", "bands"))
    sets = store(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")

    def texts_of(sids: DataFrame) -> DataFrame:
        """(sid, text): the text of the row that stands for each set."""
        wanted = sent(store(sets.select("sid", "row").join(sids, "sid", "left_semi"), "wanted"))
        return docs.select("row", "text").join(wanted, "row").select("sid", "text")

    banded = sets.select("sid", F.posexplode("bands").alias("band", "key"))
    pivots = (banded.groupBy("key").agg(F.min("sid").alias("pivot"), F.count("*").alias("n")).filter("n > 1"))
    buckets = store(banded.join(sent(store(pivots, "pivots")), "key"), "buckets")
    pairs = buckets.filter("sid <> pivot").select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct()
    one = sets.select(F.col("sid").alias("a"), F.col("signature").alias("one"))
    two = sets.select(F.col("sid").alias("b"), F.col("signature").alias("two"))
    likely = store(_survivors(pairs.join(one, "a").join(two, "b"), similarity, miss), "likely")

    first = likely.groupBy("a").agg(F.max_by("b", F.struct("matches", -F.col("b"))).alias("b"))
    ends = likely.select(F.col("a").alias("sid")).union(likely.select(F.col("b").alias("sid"))).distinct()
    texts = store(texts_of(ends), "texts")
    links = store(verified(first, texts, percent, shingle), "links")
    component = components(links, store)

    left = _between(likely.join(first, ["a", "b"], "left_anti"), component)
    more = store(verified(left, texts, percent, shingle), "links")
    if not more.isEmpty():
        links = links.union(more)
        component = components(links, store)

    members = (buckets.filter("n > 2").join(component.withColumnRenamed("node", "sid"), "sid", "left")
               .withColumn("component", F.coalesce("component", "sid")))
    several = (members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
               .filter("low <> high").select("key"))
    members = members.join(several, "key")
    more = store(_across(members, sets, texts_of, percent, shingle, miss, store), "links")
    if not more.isEmpty():
        component = components(links.union(more), store)

    of_set = sets.select("sid", "set_key", "doc_id", "row").join(component.withColumnRenamed("node", "sid"), "sid", "left")
    of_set = of_set.withColumn("component", F.coalesce("component", "sid"))
    smallest = (of_set.groupBy("component").agg(_least())
                .select("component", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first")))
    named = of_set.select("component", "set_key").join(smallest, "component").select("set_key", "component_id", "first")
    with_words = rows.filter("set_key IS NOT NULL").join(named, "set_key")
    kept = F.col("row") == F.col("first") if row else F.col("doc_id").eqNullSafe(F.col("component_id"))
    columns = [*([F.col("row").alias(row)] if row else []), F.col("doc_id"), F.col("n_shingles")]
    out = (with_words.select(*columns, "component_id", kept.alias("kept"))
           .unionByName(rows.filter("set_key IS NULL").select(*columns, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))))
    out = written(out, "near")
    store.remove()
    return out


def _between(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    one = component.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    two = component.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    return (pairs.join(one, "a", "left").join(two, "b", "left")
            .filter("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b"))
