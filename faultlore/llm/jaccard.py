"""Join of texts by the Jaccard similarity of their shingle sets: universe partition and pigeonhole.

1. Sizes fall into bands, each wide enough that a set's partners of at most its own
   size lie in its band or the one below.  A band's sets of size at most n differ from
   a linked set in at most h(n) shingles; the universe of shingles is cut by hash into
   h + 1 segments, so linked sets agree in a whole segment.
2. Each set is indexed by the subset that falls into each of its band's segments, and
   probes with its subsets in the segments of its own band and the one below.
3. Allocation by cost.  A set can skip costly segments, those whose subset more than
   ``HOT`` sets have: some for nothing, where its own size allows fewer differences
   than the band does, and each other one against a segment that it probes with
   one deletion too, as long as that costs fewer lookups than it saves.  A segment
   probed with one deletion finds subsets that differ in one shingle: the probe's
   subset less one shingle is looked up in the index, the probe's subset in the
   one-deletion neighbourhood of the index.  A set that skips k segments and probes k
   others so still spends h + 1, and one of its segments has to show the partner.  An
   indexed set needs its neighbourhood only if it has a costly subset itself: else
   the two sets differ in all skipped segments, and agree in another one.
4. Exact verification on words.  A bucket's members are first compared with its most
   central one; those that then are still in different components are compared among
   each other, in small buckets pair by pair, in large ones inside blocks of bounded
   size.  So a bucket costs its square only where its members are not linked.
   Before texts are read, two sets are compared by bits: each shingle turns one bit
   over, so bits that differ are no more than shingles that differ.

Hashes decide candidates alone: agreement of hashes that is none costs a comparison.
Sets are hashed to 64 bits a shingle and 128 bits a set.

Edge cases.  Null, empty and blank texts have an empty set: 0 shingles, linked with
nothing, each its own component.  Equal sets are linked whatever their size.  Repeated
rows have one component.  A row whose ``doc_id`` is null has the component of its
set, null if no row of the component has an id.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlore.llm.common import Scratch, column, placed, sent, slices, written
from faultlore.llm.graph import components
from faultlore.llm.shingles import set_key, shingle_hashes, shingle_set, similar, verified
from faultlore.llm.words import mixed, words

#: Sets beyond which a subset counts as costly; rows of a block, with and without texts, and its bytes of text.
HOT, BLOCK, TEXTS, BLOCK_BYTES = 64, 2048, 512, 16 << 20
#: The fewest bits of a set.
BITS = 512
SIGNED = "row binary, doc_id long, size long, set_key binary, bits binary, own array<long>, lower array<long>"
MADE = "sid long, kind int, key long"
#: Kinds of keys that allocation makes: skipped ones, the probe's subsets less one shingle, its subsets, and the index's less one.
SKIPPED, LESS_ONE, PROBED, NEIGHBOUR = range(4)


class Bands:
    """Bands of sizes for a similarity in per cent; below the first only equal sets are linked."""

    def __init__(self, percent: int):
        self.percent, self.rest = percent, 100 - percent
        self.starts = [-(-percent // self.rest) if self.rest else 1 << 62]

    def start(self, band: int) -> int:
        while len(self.starts) <= band:
            last = self.starts[-1]
            self.starts.append(max(last + 1, -(-100 * last // self.percent)))
        return self.starts[band]

    def roles(self, size: int) -> list[int]:
        """The band of a size and, where a partner may lie there, the one below."""
        if size < self.starts[0]:
            return []
        while self.starts[-1] <= size:
            self.start(len(self.starts))
        own = int(np.searchsorted(self.starts, size, "right")) - 1
        return [own] + [own - 1] * (own > 0 and -(-self.percent * size // 100) < self.starts[own])

    def segments(self, band: int) -> int:
        """One more than sets of the band can differ from a linked set that is not smaller."""
        return (self.start(band + 1) - 1) * self.rest // self.percent + 1

    def needed(self, size: int, band: int) -> int:
        """One more than a set of this size can differ from a linked set of the band that is not larger."""
        return (min(size, self.start(band + 1) - 1) + size) * self.rest // (100 + self.percent) + 1


def _segmented(shingles: np.ndarray, segments: int) -> np.ndarray:
    """The limits of each segment in ascending shingle hashes."""
    of = (shingles >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    return np.searchsorted(of, np.arange(segments + 1, dtype=np.uint64))


def _keys(band: int, segment: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Keys of subsets, from their band, segment and sum of hashes."""
    return mixed(sums + mixed((np.uint64(band) << np.uint64(32)) + segment.astype(np.uint64) + np.uint64(1)))


def _subsets(shingles: np.ndarray, band: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Limits, sums and keys of a set's subset in each segment."""
    limits = _segmented(shingles, segments)
    before = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(shingles, out=before[1:])
    sums = before[limits[1:]] - before[limits[:-1]]
    return limits, sums, _keys(band, np.arange(segments), sums)


def _less_one(shingles: np.ndarray, band: int, limits: np.ndarray, sums: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Keys of the subsets in ``segments`` less each of their shingles."""
    counts = limits[segments + 1] - limits[segments]
    of = np.repeat(segments, counts)
    inside = np.concatenate([shingles[limits[s]:limits[s + 1]] for s in segments]) if len(segments) else shingles[:0]
    return _keys(band, of, sums[of] - inside)


def allocation(lengths: np.ndarray, spare: int, costly: dict[int, int]) -> tuple[list[int], list[int]]:
    """Segments to skip and segments to probe with one deletion.

    ``costly`` has the number of sets by segment.  ``spare`` segments are skipped for
    nothing; each other one needs a cheaper segment, probed with one deletion, whose
    cost is its lookups.
    """
    dearest = sorted(costly, key=lambda s: (-costly[s], s))
    skipped, rest = dearest[:spare], dearest[spare:]
    cheapest = sorted((2 * (int(n) + 1), s) for s, n in enumerate(lengths) if n and s not in costly)
    widened = []
    for segment, (cost, instead) in zip(rest, cheapest):
        if costly[segment] <= cost:
            break
        skipped.append(segment)
        widened.append(instead)
    return skipped, widened


def parity(shingles: np.ndarray) -> bytes:
    """At least as many bits as shingles, each turned over by the shingles that hash to it."""
    n = max(BITS, 1 << int(len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1, bitorder="little").tobytes()


def folded(bits: list[bytes]) -> np.ndarray:
    """Bits of several sets, as rows of 64-bit numbers, folded to the fewest that one of them has."""
    least, out = min(map(len, bits)), []
    for own in bits:
        words_of = np.frombuffer(own, np.uint64)
        out.append(np.bitwise_xor.reduce(words_of.reshape(-1, least // 8), axis=0))
    return np.stack(out)


def _differ(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The bits in which rows differ."""
    return np.bitwise_count(one ^ two).sum(-1, dtype=np.int64)


def signed(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """row, doc_id, size, key and bits of each document's set, and its keys in its own band and the one below."""
    def sign(batches):
        bands = Bands(percent)
        for batch in batches:
            for part, data, offsets in slices(batch):
                _, _, hashes, limits = words(data, offsets, lower=True)
                sizes, keys, bits, subsets = [], [], [], ([], [])
                for low, high in zip(limits[:-1], limits[1:]):
                    own = shingle_hashes(hashes[low:high], shingle)
                    sizes.append(len(own))
                    keys.append(set_key(own) if len(own) else None)
                    roles = bands.roles(len(own))
                    bits.append(parity(own) if roles else None)
                    for i in range(2):
                        subsets[i].append(_subsets(own, roles[i], bands.segments(roles[i]))[2].view(np.int64) if i < len(roles) else None)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "row").cast(pa.binary()), column(part, "doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(keys, pa.binary()), pa.array(bits, pa.binary()), *(pa.array(s, pa.list_(pa.int64())) for s in subsets)],
                    names=["row", "doc_id", "size", "set_key", "bits", "own", "lower"])

    return docs.select("row", "doc_id", "text").mapInArrow(sign, SIGNED)


def allocated(costly: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The keys (sid, kind, key) that allocation makes for ``costly`` (sid, text, costly)."""
    def made(shingles: np.ndarray, roles: dict[bool, dict[int, int]], bands: Bands):
        size = len(shingles)
        for lower, band in zip((False, True), bands.roles(size)):
            segments = bands.segments(band)
            limits, sums, keys = _subsets(shingles, band, segments)
            mine = roles.get(lower, {})
            skipped, widened = allocation(np.diff(limits), segments - bands.needed(size, band), mine)
            yield SKIPPED, keys[skipped]
            yield LESS_ONE, _less_one(shingles, band, limits, sums, np.array(widened, np.int64))
            yield PROBED, keys[widened]
            if mine and not lower:
                yield NEIGHBOUR, _less_one(shingles, band, limits, sums, np.arange(segments))

    def allocate(batches):
        bands = Bands(percent)
        for batch in batches:
            for part, data, offsets in slices(batch):
                _, _, hashes, limits = words(data, offsets, lower=True)
                out: tuple[list, list, list] = ([], [], [])
                for sid, of, low, high in zip(column(part, "sid").to_pylist(), column(part, "costly"), limits[:-1], limits[1:]):
                    roles: dict[bool, dict[int, int]] = {}
                    for one in of.as_py():
                        roles.setdefault(one["lower"], {})[one["segment"]] = one["n"]
                    for kind, keys in made(shingle_hashes(hashes[low:high], shingle), roles, bands):
                        out[0].append(np.full(len(keys), sid, np.int64))
                        out[1].append(np.full(len(keys), kind, np.int32))
                        out[2].append(keys.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names=["sid", "kind", "key"])

    return costly.select("sid", "text", "costly").mapInArrow(allocate, MADE)


def _buckets(sets: DataFrame, texts_of, percent: int, shingle: int, store: Scratch, hot: int) -> DataFrame:
    """Buckets (key, sid, size, n, probe, index) with a probe and another indexed set."""
    def entries(role: str) -> DataFrame:
        return sets.select("sid", "size", F.lit(role == "lower").alias("lower"), F.posexplode(role).alias("segment", "key"))

    every = entries("own").unionByName(entries("lower"))
    counts = (every.groupBy("key").agg(F.count("*").alias("n"), F.min("lower").alias("none"))
              .filter("n > 1 AND NOT none").select("key", "n"))
    met = store(every.join(counts, "key"), "met")
    costly = store(met.filter(F.col("n") > hot).groupBy("sid").agg(F.collect_list(F.struct("lower", "segment", "n")).alias("costly")), "costly")
    columns = ["key", "sid", "size", "probe", "index"]
    if costly.isEmpty():
        return met.withColumn("probe", F.lit(True)).withColumn("index", ~F.col("lower")).select("n", *columns)
    made = store(allocated(texts_of(costly.select("sid")).join(costly, "sid"), percent, shingle), "made")
    skipped = made.filter(F.col("kind") == SKIPPED).select("sid", "key", F.lit(True).alias("skipped")).distinct()
    exact = met.join(skipped, ["sid", "key"], "left").withColumn("probe", F.col("skipped").isNull()).withColumn("index", ~F.col("lower"))
    # the two ways in which subsets differ by one shingle, each with keys of its own
    own = sets.select("sid", F.explode("own").alias("key"))
    of_kind = {kind: made.filter(F.col("kind") == kind).select("sid", "key") for kind in (LESS_ONE, PROBED, NEIGHBOUR)}
    others = exact.select(*columns)
    for tag, probes, index in ((1, of_kind[LESS_ONE], own), (2, of_kind[PROBED], of_kind[NEIGHBOUR])):
        wanted = sent(store(probes.select("key").distinct(), "wanted"))
        found = store(index.join(wanted, "key", "left_semi").select("sid", "key").distinct(), "found")
        both = (probes.join(found.select("key").distinct(), "key", "left_semi").select("sid", "key", F.lit(True).alias("probe"), F.lit(False).alias("index"))
                .unionByName(found.select("sid", "key", F.lit(False).alias("probe"), F.lit(True).alias("index"))))
        both = both.groupBy("sid", F.xxhash64("key", F.lit(tag)).alias("key")).agg(F.max("probe").alias("probe"), F.max("index").alias("index"))
        others = others.unionByName(both.join(sets.select("sid", "size"), "sid").select(*columns))
    others = store(others, "subsets")
    n = others.groupBy("key").agg(F.count("*").alias("n"), F.max("probe").alias("p"), F.max("index").alias("i")).filter("n > 1 AND p AND i")
    return others.join(n.select("key", "n"), "key").select("n", *columns)


def _close(percent: int, one: str = "size", two: str = "of_size"):
    """Whether two sizes allow the similarity."""
    return F.least(one, two) * 100 >= F.greatest(one, two) * percent


def _with_component(of: DataFrame, component: DataFrame) -> DataFrame:
    named = component.withColumnRenamed("node", "sid")
    return of.join(named, "sid", "left").withColumn("component", F.coalesce("component", "sid"))


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose bits differ in no more than their sets may."""
    def compare(batches):
        for batch in batches:
            keep = []
            for one, two, size in zip(*(column(batch, c).to_pylist() for c in ("one", "two", "sizes"))):
                bits = folded([one, two])
                keep.append(int(_differ(bits[0], bits[1])) <= size * (100 - percent) // (100 + percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("sid").alias("a"), F.col("bits").alias("one"), F.col("size").alias("size_a"))
    two = sets.select(F.col("sid").alias("b"), F.col("bits").alias("two"), F.col("size").alias("size_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").withColumn("sizes", F.col("size_a") + F.col("size_b"))
    return both.select("a", "b", "one", "two", "sizes").mapInArrow(compare, "a long, b long")


def _meeting(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """``members`` once for every two blocks of their bucket that meet: low, high and the own block."""
    return (members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))


class _Group:
    """Two blocks of a bucket: whom a member may be linked with."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent, self.bits = percent, folded(table["bits"].to_pylist())
        self.sid, self.size, self.label, self.block = (table[c].to_numpy().copy() for c in ("sid", "size", "component", "block"))
        self.probe, self.index = (np.array(table[c].to_pylist(), bool) for c in ("probe", "index"))
        self.low, self.high = table["low"][0].as_py(), table["high"][0].as_py()

    def first(self) -> np.ndarray:
        return np.flatnonzero(self.block == self.low)

    def possible(self, i: int) -> np.ndarray:
        """Members in other components, one of both a probe and the other indexed, alike by size and bits."""
        rest = np.flatnonzero((self.label != self.label[i]) & (self.block == self.high)
                              & ((self.low != self.high) | (self.sid > self.sid[i]))
                              & (self.probe & self.index[i] | self.index & self.probe[i])
                              & (100 * np.minimum(self.size, self.size[i]) >= self.percent * np.maximum(self.size, self.size[i])))
        most = (self.size[rest] + self.size[i]) * (100 - self.percent) // (100 + self.percent)
        return rest[_differ(self.bits[rest], self.bits[i]) <= most]


def _inside_blocks(members: DataFrame, texts_of, percent: int, shingle: int, store: Scratch) -> DataFrame:
    """Links (a, b) between components of large buckets: (key, sid, size, probe, index, component, bits).

    Every two blocks of a bucket meet in a group.  The first time, without texts, groups
    find the members with a possible partner; only these get their texts and meet
    again, in blocks bounded by bytes too.
    """
    def alive(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group, found = _Group(table, percent), set()
        for i in group.first():
            others = group.possible(i)
            if len(others):
                found.update((int(i), *others.tolist()))
        return table.select(["key", "sid"]).take(pa.array(sorted(found), pa.int64()))

    members = members.select("key", "sid", "size", "probe", "index", "component", "bits")
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    likely = store(_meeting(members, blocks).groupBy("key", "low", "high").applyInArrow(alive, "key long, sid long").distinct(), "likely")
    of = members.join(likely, ["key", "sid"]).join(texts_of(likely.select("sid").distinct()), "sid")
    of = store(of.withColumn("bytes", F.octet_length("text")), "texts")
    blocks = of.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / TEXTS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group = _Group(table, percent)
        known: dict[int, set] = {}

        def words_of(i: int) -> set:
            if i not in known:
                known[i] = shingle_set(table["text"][i].as_py(), shingle)
            return known[i]

        links, label = [], group.label
        for i in group.first():
            for j in group.possible(i):
                if label[i] != label[j] and similar(words_of(int(i)), words_of(int(j)), percent):
                    links.append((group.sid[i], group.sid[j]))
                    label[label == label[j]] = label[i]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _meeting(of, blocks).groupBy("key", "low", "high").applyInArrow(compare, "a long, b long")


def jaccard_join(docs: DataFrame, percent: int = 90, shingle: int = 3, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    Rows are linked where 100 * |intersection| >= percent * |union| of their sets of
    ``shingle`` words; a component is named by its smallest doc_id.  A subset that more
    than ``hot`` sets have counts as costly.
    """
    store = Scratch(docs.sparkSession, "jaccard")
    docs = placed(docs, "doc_id", "text", store=store)
    rows = store(signed(docs, percent, shingle), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    sets = (rows.filter("set_key IS NOT NULL").groupBy("set_key")
            .agg(least, *(F.first(c).alias(c) for c in ("size", "bits", "own", "lower")))
            .select("set_key", "least.doc_id", "least.row", "size", "bits", "own", "lower"))
    sets = store(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")

    def texts_of(sids: DataFrame) -> DataFrame:
        """(sid, text): the text of the row that stands for each set."""
        wanted = sent(store(sets.select("sid", "row").join(sids, "sid", "left_semi"), "wanted"))
        return docs.select("row", F.coalesce("text", F.lit("")).alias("text")).join(wanted, "row").select("sid", "text")

    buckets = _buckets(sets, texts_of, percent, shingle, store, hot)
    central = buckets.groupBy("sid").agg(F.sum("n").alias("score"))
    buckets = store(buckets.join(central, "sid"), "buckets")
    # the most central member that probes, if possible an indexed one
    pivots = (buckets.filter("probe").groupBy("key").agg(F.max(F.struct("index", "score", F.col("sid").alias("pivot"), F.col("size").alias("of_size"))).alias("m"))
              .select("key", "m.pivot", "m.of_size", F.col("m.index").alias("full"), F.col("m.score").alias("of_score")))
    met = (buckets.join(pivots, "key").filter("sid <> pivot AND (index OR full AND probe)").filter(_close(percent))
           .select("sid", "pivot", "of_score"))

    def linked(some: DataFrame) -> DataFrame:
        possible = store(_possible(some, sets, percent), "possible")
        ends = possible.select(F.col("a").alias("sid")).union(possible.select(F.col("b").alias("sid"))).distinct()
        return store(verified(possible, store(texts_of(ends), "texts"), percent, shingle), "links")

    # of the pivots that a set meets, the most central; others only where that does not join the bucket
    first = store(met.groupBy(F.col("sid").alias("a")).agg(F.max_by("pivot", F.struct("of_score", "pivot")).alias("b")), "first")
    links = linked(first)
    component = components(links, store)
    tried = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def divided(of: DataFrame) -> DataFrame:
        """Members of the buckets that still hold several components."""
        members = _with_component(of, component)
        several = (members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                   .filter("low <> high").select("key"))
        return members.join(several, "key")

    members = store(divided(buckets.filter(F.col("n") <= hot)), "members")
    other = members.select("key", F.col("sid").alias("of"), F.col("size").alias("of_size"), F.col("component").alias("of_component"), "index")
    more = (members.filter("probe").drop("index").join(other.filter("index"), "key").filter("component <> of_component").filter(_close(percent))
            .select(F.greatest("sid", "of").alias("a"), F.least("sid", "of").alias("b")).distinct()
            .join(tried, ["a", "b"], "left_anti"))
    more = store(more, "pairs")
    found = not more.isEmpty()
    if found:
        links = links.union(linked(more))
    members = store(divided(buckets.filter(F.col("n") > hot)), "members")
    if not members.isEmpty():
        members = store(members.join(sets.select("sid", "bits"), "sid"), "members")
        links, found = links.union(store(_inside_blocks(members, texts_of, percent, shingle, store), "links")), True
    if found:
        component = components(links, store)

    of_set = _with_component(sets.select("sid", "set_key", "doc_id"), component)
    smallest = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = of_set.join(smallest, "component").select("set_key", "component_id")
    slim = rows.select("doc_id", F.col("size").alias("n_shingles"), "set_key")
    out = (slim.filter("set_key IS NOT NULL").join(named, "set_key").select("doc_id", "n_shingles", "component_id")
           .unionByName(slim.filter("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))
    out = written(out, "jaccard")
    store.remove()
    return out
