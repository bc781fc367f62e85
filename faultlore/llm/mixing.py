"""Mixtures of sources with target weights, drawn in exact numbers of blocks.

1. Target.  Sources by name, null last, weigh ``weights`` in turn and share
   ``share`` of all words; no target exceeds ``most`` times its source, and the
   excess goes to the others by weight.
2. Blocks.  A hash of id, text and number among identical rows deals each source's documents into ``BLOCKS`` blocks in
   a random order, so taking the first blocks takes a random part.  A target takes
   all blocks as often as it is a multiple of the source, and then the first
   blocks up to the one in which it ends; of that block, documents by hash, and of
   the document in which it ends, the first words.
3. Splitting tree.  The blocks to take, by source, are a population that is split
   among two halves of the output shards: how many blocks of each source go left
   is a multivariate hypergeometric draw.  Halves are split on until one shard is
   left, whose quotas are exact: shards are random samples without replacement.
4. Shards draw disjoint runs of the permuted blocks, as long as their quotas.  What a
   mixture takes of a document is what its shards draw of it.
5. Texts go to their shards once, and each shard is sorted by a hash on its own.

Counts by source, ``BLOCKS`` each, are all that is gathered; one row per source, with
a number per shard, comes to the driver, as the list of sources is a catalogue.

Edge cases.  Null and blank texts have size 0 and are never taken.  Null is a source
of its own, the last.  Rows with a null or repeated ``doc_id`` differ by their
texts, identical rows by a number among them, so every row has a rank of its own and
the target ends inside one row.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
from math import exp, lgamma

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlore.llm.common import Scratch, placed, sent, unused, written

BLOCKS = 4096
#: The fewest shards, and words of a shard beyond these; tasks that number rows which are all alike.
SHARDS, SHARD_WORDS, PARTS = 64, 1 << 26, 256
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
            most: float = 2.0) -> dict[str | None, float]:
    """Words that each source gives to the mixture, from (source, words)."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {source: weights[i % len(weights)] for i, (source, _) in enumerate(order)}
    size, left = dict(order), share * sum(n for _, n in order)
    out: dict[str | None, float] = {}
    while len(out) < len(order):
        rest = [s for s, _ in order if s not in out]
        total = sum(weight[s] for s in rest)
        full = [s for s in rest if left * weight[s] / total > most * size[s]]
        if not full:
            return {s: out.get(s, left * weight[s] / total) for s, _ in order}
        for s in full:
            out[s] = most * size[s]
        left -= sum(out[s] for s in full)
    return {s: out[s] for s, _ in order}


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """The number of good ones among ``draws`` without replacement, by inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low

    def choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    peak = exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - peak
    up, down, p_up, p_down = mode, mode, peak, peak
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Quotas of each shard; they add up to ``quotas``, and shards' totals differ by rounding alone."""
    if shards == 1:
        return [quotas]
    rng = random.Random(f"{seed}:{shards}:{quotas}")
    half = shards // 2
    total, draws, left = sum(quotas), sum(quotas) * half // shards, []
    for quota in quotas:
        total -= quota
        left.append(hypergeometric(rng, quota, total, draws))
        draws -= left[-1]
    right = [a - b for a, b in zip(quotas, left)]
    return split_quotas(left, half, 2 * seed) + split_quotas(right, shards - half, 2 * seed + 1)


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def _digest(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("text"))


def _numbers(slim: DataFrame, store: Scratch) -> DataFrame:
    """(row, number) of each row of ``slim`` that has its like: identical rows differ by the number alone.

    Rows are numbered inside parts of a group, which follow each other by their
    counts, so a group of any size is spread over ``PARTS`` tasks.
    """
    like = slim.select("row", F.xxhash64(F.struct("source", "doc_id", "digest")).alias("like"), F.pmod(F.xxhash64("row"), F.lit(PARTS)).alias("part"))
    several = store(like.groupBy("like").count().filter("count > 1").select("like"), "several")
    like = store(like.join(sent(several), "like"), "like")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("like").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = like.groupBy("like", "part").agg(F.count("*").alias("n")).withColumn("before", before).select("like", "part", "before")
    inside = F.row_number().over(Window.partitionBy("like", "part").orderBy("row"))
    return store(like.withColumn("inside", inside).join(parts, ["like", "part"])
                 .select("row", (F.col("before") + F.col("inside")).cast("int").alias("number")), "numbers")


def _dealt(rows: DataFrame, numbers: DataFrame, seed: int) -> DataFrame:
    """``rows`` (row, doc_id, digest, ...) with the block and the rank within the block of each."""
    own = rows.join(sent(numbers), "row", "left")
    own = own.withColumn("digest", F.xxhash64("digest", "doc_id", F.coalesce("number", F.lit(1)))).drop("number")
    return (own.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("digest")), F.lit(BLOCKS)).cast("int"))
            .withColumn("rank", F.xxhash64(F.lit(seed + 1), F.col("digest"))).drop("digest"))


def plan(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """One row per source of ``docs`` (doc_id, size, source, block, rank).

    source, source_size, target, quota (blocks taken, each as often as it is taken),
    last_rank and last_words (the document of the last block in which the target
    ends), and starts and lengths of each shard's run of blocks.
    """
    spark = docs.sparkSession
    blocks = docs.groupBy("source", "block").agg(F.sum("size").alias("words"))
    sums = [(r["source"], r["words"]) for r in blocks.groupBy("source").agg(F.sum("words").alias("words")).collect()]
    target = targets(sums)
    rows = []
    for source, words in sums:
        whole = round(target[source]) // words if words else 0
        rows.append((source, words, target[source], whole, round(target[source]) - whole * words))
    schema = "source string, source_size long, target double, whole int, rest long"
    wanted = _small(spark, rows, schema)
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(by_block), F.lit(0))
    same = F.col("source").eqNullSafe(F.col("of_source"))
    wanted = wanted.select(F.col("source").alias("of_source"), "rest")
    ends = (blocks.withColumn("before", before).join(F.broadcast(wanted), same)
            .filter("before <= rest AND before + words > rest")
            .select("of_source", F.col("block").alias("upto"), (F.col("rest") - F.col("before")).alias("left")))
    inside = docs.join(F.broadcast(ends), same & (F.col("block") == F.col("upto"))).select("source", "rank", "size", "left")
    by_rank = Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("to", F.sum("size").over(by_rank))
    inside = inside.filter("to > left").groupBy("source").agg(F.min_by(F.struct("rank", (F.col("left") - F.col("to") + F.col("size")).alias("words")), "rank").alias("last"))
    ended = {r["of_source"]: r["upto"] for r in ends.collect()}
    last = {r["source"]: (r["last"]["rank"], r["last"]["words"]) for r in inside.collect()}
    quotas = [whole * BLOCKS + (ended[s] + 1 if s in ended else 0) for s, _, _, whole, _ in rows]
    parts = split_quotas(quotas, shards, seed)
    out = []
    for i, (source, words, goal, _, _) in enumerate(rows):
        starts = [sum(p[i] for p in parts[:k]) for k in range(shards)]
        rank, cut = last.get(source, (None, 0))
        out.append((source, words, goal, quotas[i], rank, cut, starts, [p[i] for p in parts]))
    return _small(spark, out, "source string, source_size long, target double, quota int, last_rank long, "
                              "last_words long, starts array<int>, lengths array<int>")


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a constant table, without Python in its plan."""
    names = [field.split()[0] for field in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    fields = ", ".join(":".join(field.split()) for field in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def drawn(own: DataFrame, of: DataFrame) -> DataFrame:
    """The mixture: ``own`` (size, source, block, rank, ...) once for each time that a shard draws it.

    Adds copy, shard and words.  A shard draws a run of the source's permuted blocks,
    as long as its quota; of the last block of all, documents by rank, the last in part.
    """
    met = own.filter("size > 0").join(F.broadcast(of.withColumnRenamed("source", "of_source")),
                                      F.col("source").eqNullSafe(F.col("of_source"))).filter("quota > 0")
    copies = F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / BLOCKS).cast("int"))
    met = met.withColumn("copy", F.explode(copies)).withColumn("unit", F.col("copy") * BLOCKS + F.col("block"))
    # the run that holds the unit; none beyond the quotas
    runs = F.zip_with("starts", "lengths", lambda start, n: (start <= F.col("unit")) & (F.col("unit") < start + n))
    met = met.withColumn("shard", F.array_position(runs, F.lit(True)).cast("int") - 1).filter("shard >= 0")
    cut = F.when(F.col("rank") < F.col("last_rank"), F.col("size")).when(
        F.col("rank") == F.col("last_rank"), F.least("size", "last_words")).otherwise(0)
    ends = (F.col("unit") == F.col("quota") - 1) & F.col("last_rank").isNotNull()
    return met.withColumn("words", F.when(ends, cut).otherwise(F.col("size")).cast("long")).filter("words > 0")


class _Rows:
    """Rows of a table as the mixture needs them: slim ones, stored, and the plan."""

    def __init__(self, docs: DataFrame, shards: int | None, seed: int):
        self.store, self.seed = Scratch(docs.sparkSession, "mixing"), seed
        slim = docs.select("row", "doc_id", "source", _size().alias("size"), _digest(seed).alias("digest"))
        self.slim = self.store(slim, "sizes")
        self.numbers = _numbers(self.slim, self.store)
        self.own = self.store(_dealt(self.slim, self.numbers, seed), "dealt")
        if shards is None:
            words = self.own.agg(F.sum("size")).first()[0] or 0
            shards = max(SHARDS, -(-words // SHARD_WORDS))
        self.shards = shards
        self.plan = plan(self.own, shards, seed)


def mixture_sizes(docs: DataFrame, shards: int | None = None, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of ``docs`` (doc_id, text, source).

    ``taken`` adds up what the shards draw of a row.
    """
    rows = _Rows(placed(docs, "doc_id", "text", "source"), shards, seed)
    taken = drawn(rows.own, rows.plan).groupBy("row").agg(F.sum("words").alias("taken"))
    of = F.broadcast(rows.plan.select(F.col("source").alias("of_source"), "source_size", "target"))
    out = (rows.own.join(taken, "row", "left").join(of, F.col("source").eqNullSafe(F.col("of_source")), "left")
           .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))
    out = written(out, "mixture")
    rows.store.remove()
    return out


def mixed_documents(docs: DataFrame, shards: int | None = None, seed: int = 17) -> DataFrame:
    """The mixture: rows of ``docs``, a document as often as it is taken, by shard and in random order within it.

    The text of a document that is taken in part is its first words, up to the end
    of the last one; ``n_chars``, where there is one, follows.  Texts are shuffled
    once, to their shards.
    """
    names, key = docs.columns, unused(docs, "row")
    docs = placed(docs, *names, name=key)
    docs = docs.select(F.col(key).alias("row"), "doc_id", "text", "source", F.struct(*(F.col(c) for c in names if c != "text")).alias("rest"))
    rows = _Rows(docs, shards, seed)
    numbers = written(rows.numbers, "numbers")
    rows.store.remove()
    own = _dealt(docs.withColumn("size", _size()).withColumn("digest", _digest(seed)), numbers, seed)
    own = drawn(own, rows.plan)
    part = F.col("words") < F.col("size")
    first = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("words").cast("string"), F.lit("}+"))
    text = F.when(part, F.call_function("regexp_extract", F.col("text"), first, F.lit(0))).otherwise(F.col("text"))
    own = own.withColumn("order", F.xxhash64(F.lit(seed + 2), "rank", "copy")).withColumn("text", text)
    columns = {c: F.col("text") if c == "text" else F.col("rest").getField(c) for c in names}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(part, F.length("text").cast("long")).otherwise(columns["n_chars"])
    return (own.repartitionById(rows.shards, F.col("shard")).sortWithinPartitions("order")
            .select(*(columns[c].alias(c) for c in names)))
