"""Source divergence audit: how a source's use of terms differs from other sources and from its language.

1. Late string materialization.  Each text's terms are counted within a task per
   language, source and term, and stored by the 64-bit digest of language and term,
   each string once a task.  Counting, joining and summing move fixed-width
   digests of terms and groups only.
2. Each language keeps the terms in at least ``documents`` of its documents.  A term's
   share in a group is 1 + floor(10^9 * (count + 1) / (all counts + kept terms)).
3. Collisions.  The smallest and the largest string of each kept digest are found from
   the stored table; where they differ, the digest stands for several terms and
   is counted again by string.
4. Pairs of sources are summed over all kept terms without listing the terms that a
   source lacks: with p0 the share of a lacking term, the sum is
   V * f(p0, q0) + sum over the own terms of f(p, q0) - f(p0, q0), the same over
   the other's terms, and over shared terms f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).
   The first sums need a source's number of terms per count alone; shared terms are
   met within a term's own row, which lists the sources that have it.
5. Reported terms.  A group's 200 largest values and how many terms have each give a
   threshold; only terms at or above it get their strings back, then ranks.

Edge cases.  Null text, language and source count as empty.  A group without terms
has a pair row for each other source of its language, and no term row; a language
without kept terms has 0 for all pairs.  Repeated rows are documents of their own.  An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlore.llm.common import Scratch, column, sent, texts, written

#: Letters of ASCII, and all characters beyond ASCII, as UTF-8.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000
#: Terms that a task counts before it hands them on; bounds its memory.
HELD = 300_000
#: Bytes of a text whose terms are listed at once; a longer text is read in parts.
PART = 1 << 20
COUNTED = "digest long, lang string, term string, of array<struct<grp: long, n: long, docs: long>>"


def _terms(text: bytes) -> Counter:
    """Counts of a text's terms; parts end at a separator, so that no term is cut."""
    out: Counter = Counter()
    low = 0
    while low < len(text):
        high = min(len(text), low + PART)
        if high < len(text):
            edge = _SEPARATOR.search(text, high)
            high = edge.start() if edge else len(text)
        out.update(TERM.findall(text, low, high))
        low = high
    return out


_SEPARATOR = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def digest(term: bytes) -> int:
    """A signed 64-bit digest."""
    return xxhash.xxh3_64_intdigest(term) - (1 << 63)


def counted(docs: DataFrame, of=digest) -> DataFrame:
    """What a task has counted of a term: its digest, language, string and, for each group, counts of places and documents."""
    kind = pa.list_(pa.struct([("grp", pa.int64()), ("n", pa.int64()), ("docs", pa.int64())]))

    def handed(lang: str, groups: dict[int, tuple[Counter, Counter]]) -> pa.RecordBatch:
        """Rows of the terms of one language, in the order in which its groups first name them."""
        places: dict[bytes, int] = {}
        at, grp, n, docs = [], [], [], []
        for group, (times, in_docs) in groups.items():
            at.extend(places.setdefault(term, len(places)) for term in times)
            grp.append(np.full(len(times), group, np.int64))
            n.append(np.fromiter(times.values(), np.int64, len(times)))
            docs.append(np.fromiter(map(in_docs.__getitem__, times), np.int64, len(times)))
        by_term = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(places)))
        fields = pa.StructArray.from_arrays([pa.array(np.concatenate(v)[by_term]) for v in (grp, n, docs)], fields=list(kind.value_type))
        head = lang.encode() + b"\0"
        return pa.RecordBatch.from_arrays(
            [pa.array([of(head + term) for term in places], pa.int64()), pa.array([lang] * len(places), pa.string()),
             pa.array([term.decode() for term in places], pa.string()),
             pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), fields).cast(kind)],
            names=["digest", "lang", "term", "of"])

    def tally(batches):
        held: dict[str, dict[int, tuple[Counter, Counter]]] = {}
        size = 0
        for batch in batches:
            groups = zip(texts(batch, "lang").to_pylist(), column(batch, "grp").to_pylist())
            for (lang, group), text in zip(groups, texts(batch).cast(pa.large_binary())):
                own = _terms(text.as_py().lower())
                if not own:
                    continue
                n, docs = held.setdefault(lang, {}).setdefault(group, (Counter(), Counter()))
                size -= len(n)
                n.update(own)
                docs.update(own.keys())
                size += len(n)
                if size >= HELD:
                    yield from (handed(*item) for item in held.items())
                    held.clear()
                    size = 0
        yield from (handed(*item) for item in held.items())

    return docs.select("lang", "grp", "text").mapInArrow(tally, COUNTED)


def _numbered(docs: DataFrame, store: Scratch) -> tuple[DataFrame, Column]:
    """All groups (lang, source, grp), and ``grp``, a 64-bit digest that differs for all of them."""
    names = store(docs.select("lang", "source").distinct(), "names")
    for seed in count():
        of = F.xxhash64(F.lit(seed), "lang", "source")
        groups = names.withColumn("grp", of)
        if groups.groupBy("grp").count().filter("count > 1").isEmpty():
            return groups, of


def _kept(counts: DataFrame, documents: int, store: Scratch) -> tuple[DataFrame, DataFrame]:
    """The kept terms (digest, split, lang_n, of) and the strings (digest, term) of their digests.

    ``of`` lists a term's groups and its counts there, at most as many as its language has
    sources; ``split`` is the term where its digest stands for several.
    """
    def by_term(flat: DataFrame, *keys: str) -> DataFrame:
        own = flat.groupBy("grp", *keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        return (own.groupBy(*keys).agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("grp", "n")).alias("of"))
                .filter(F.col("in_docs") >= documents).drop("in_docs"))

    whole = store(by_term(counts.select("digest", F.inline("of")), "digest").withColumn("split", F.lit(None).cast("string")), "kept")
    of_kept = counts.select("digest", "lang", "term").join(sent(whole.select("digest")), "digest", "left_semi")
    name = F.struct("lang", "term")
    names = store(of_kept.groupBy("digest").agg(F.min(name).alias("low"), F.max(name).alias("high")), "strings")
    strings = names.select("digest", F.col("low.term").alias("term"))
    several = store(names.filter("low <> high").select("digest"), "several")
    if several.isEmpty():
        return whole, strings
    apart = counts.join(several, "digest").select("digest", "lang", F.col("term").alias("split"), F.inline("of"))
    apart = by_term(apart, "digest", "lang", "split").drop("lang")
    return store(whole.join(several, "digest", "left_anti").unionByName(apart), "kept"), strings


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + terms)), exact for any long: as decimals where 64 bits do not hold the product."""
    wide = F.call_function("div", (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)"), (total.cast("decimal(20,0)") + terms))
    return F.when(count < SCALE, F.call_function("div", (count + 1) * F.lit(SCALE).cast("long"), total + terms)).otherwise(wide) + 1


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(terms: DataFrame, by_count: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language."""
    mine = groups.select("lang", "source", "grp", "total", "terms", "lacking")
    other = groups.select("lang", F.col("source").alias("item"), F.col("grp").alias("of_grp"), F.col("total").alias("of_total"), F.col("lacking").alias("q0"))
    both = mine.join(other, "lang").filter("source <> item")
    nothing = _value(F.col("lacking"), F.col("q0"))
    base = both.select("grp", "of_grp", F.when(F.col("terms") > 0, F.col("terms") * nothing).otherwise(0).alias("value"))
    # a source's terms are as good as their counts where the other lacks them
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("n"), F.col("of_total"), F.col("terms"))
    one = by_count.join(both, "grp").select("grp", "of_grp", (F.col("times") * (_value(p, F.col("q0")) - nothing)).alias("value"))
    two = (by_count.withColumnRenamed("grp", "of_grp").join(both, "of_grp")
           .select("grp", "of_grp", (F.col("times") * (_value(F.col("lacking"), q) - nothing)).alias("value")))
    # a term meets each other source that has it: at most as many rows as its language has sources
    own = sent(groups.select("grp", "total", "terms", "lacking"))
    item = sent(groups.select(F.col("grp").alias("of_grp"), F.col("total").alias("of_total"), F.col("lacking").alias("q0")))
    met = terms.select("of", F.inline("of")).join(own, "grp").withColumn("p", p).select(
        "grp", "p", "terms", "lacking", F.explode("of").alias("other")).filter("grp <> other.grp")
    met = met.select("grp", "p", "terms", "lacking", F.col("other.grp").alias("of_grp"), F.col("other.n").alias("of_n")).join(item, "of_grp")
    met = met.withColumn("q", _share(F.col("of_n"), F.col("of_total"), F.col("terms")))
    change = _value(F.col("p"), F.col("q")) - _value(F.col("p"), F.col("q0")) - _value(F.col("lacking"), F.col("q")) + nothing
    met = met.groupBy("grp", "of_grp").agg(F.sum(change).alias("value"))
    sums = base.unionByName(one).unionByName(two).unionByName(met).groupBy("grp", "of_grp").agg(F.sum("value").alias("value"))
    return sums.join(both.select("grp", "of_grp", "lang", "source", "item"), ["grp", "of_grp"]).select("lang", "source", "item", "value")


def _reported(shares: DataFrame, groups: DataFrame, strings: DataFrame, top: int, store: Scratch) -> DataFrame:
    """(lang, source, item, value, rank) of each group's ``top`` terms."""
    of = shares.filter("p > q").select("grp", "digest", "split", _value(F.col("p"), F.col("q")).alias("value"))
    group = Window.partitionBy("grp")
    # values, not terms: a tie of any size is one row, and tasks keep their largest before the shuffle
    values = of.groupBy("grp", "value").agg(F.count("*").alias("times"))
    values = values.withColumn("place", F.row_number().over(group.orderBy(F.desc("value")))).filter(F.col("place") <= top)
    before = F.coalesce(F.sum("times").over(group.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = values.withColumn("before", before).filter(F.col("before") < top).groupBy("grp").agg(F.min("value").alias("least"))
    likely = store(of.join(sent(store(least, "least")), "grp").filter("value >= least").drop("least"), "likely")
    # the strings of what is left, by digest
    wanted = sent(store(likely.filter("split IS NULL").select("digest").distinct(), "wanted"))
    names = store(strings.join(wanted, "digest", "left_semi"), "names")
    named = likely.join(names, "digest", "left").withColumn("item", F.coalesce("split", "term"))
    rank = F.row_number().over(group.orderBy(F.desc("value"), "item"))
    ranked = named.select("grp", "item", "value").withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(sent(groups.select("grp", "lang", "source")), "grp").drop("grp")


def source_divergence(docs: DataFrame, documents: int = 3, top: int = 200, of=digest) -> DataFrame:
    """lang, source, part, item, value and rank of the audit of ``docs`` (text, lang, source).

    ``pair``: all other sources of the language by divergence; ``term``: the ``top``
    terms that a source uses more than its language.  ``of`` digests a language and a term.
    """
    store = Scratch(docs.sparkSession, "divergence")
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    names, grp = _numbered(docs, store)
    counts = store(counted(docs.withColumn("grp", grp), of), "counts")
    terms, strings = _kept(counts, documents, store)
    flat = terms.select("digest", "split", "lang_n", F.inline("of"))
    by_count = store(flat.groupBy("grp", "n").agg(F.count("*").alias("times")), "by_count")
    totals = by_count.groupBy("grp").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
    # all groups of a term are of one language
    of_lang = (terms.select(F.col("of")[0]["grp"].alias("grp"), "lang_n").groupBy("grp").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
               .join(names, "grp").groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum("lang_total").alias("lang_total")))
    groups = (names.join(totals, "grp", "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
              .withColumn("lacking", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)))
    groups = store(groups, "groups")
    shares = flat.join(sent(groups), "grp").select(
        "grp", "digest", "split", "n", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(terms, by_count, groups).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", F.col("item"), F.col("value").cast("long").alias("value"), "rank"]
    out = (pairs.select(F.lit("pair").alias("part"), *columns)
           .unionByName(_reported(shares, groups, strings, top, store).select(F.lit("term").alias("part"), *columns)))
    out = written(out.select("lang", "source", "part", "item", "value", "rank"), "divergence")
    store.remove()
    return out


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.n + v.v)::HUGEINT AS q
      FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
rows AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM every LEFT JOIN pair USING (lang, source, item)
         UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
