"""Quality rules and the likeness of a text to trusted text.

Counts of words, symbols, repeated lines and repeated runs of words make the base
rules.  Words and pairs of words are hashed into ``BUCKETS`` buckets; one
multinomial is counted over all documents (raw corpus), one over those labelled as
good (trusted target).  A text's score is its log-likelihood ratio between the two
per n-gram, and a text is kept if it scores no less than ``QUANTILE`` of the trusted
texts do.  All of it is made of built-in functions.

The trusted target is all rows labelled as good; the raw counts cover every document.
The model has ``BUCKETS`` numbers, and the least score kept is found by narrowing
counts of ranges of scores, so neither grows with the corpus.

Edge cases.  Null and blank texts have no words and fail the base rules.  Without
trusted rows all scores are 0 and the base rules decide.  Rows with a null ``doc_id``
are never trusted and else like others; repeated rows count each time.  Runs of
words are compared by 64-bit hashes.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from math import ceil, floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlore.llm.common import Scratch, sent, written

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RUN = 8
BUCKETS, QUANTILE = 10_000, 0.01
#: Ranges that scores are counted in at once, and scores that are read at once.
RANGES, FEW = 1000, 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def repeated_words(hashes: Column) -> Column:
    """Number of words in runs of ``RUN`` words that occur twice or more; ``hashes`` is a bound variable."""
    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda i, k: F.least(F.lit(RUN), F.coalesce(F.get(at, k + 1) - i, F.lit(RUN)))),
            F.lit(0).cast("long"), lambda total, n: total + n)

    def of_sorted(rows: Column) -> Column:
        twice = F.filter(rows, lambda r, k: F.coalesce(F.get(rows, k - 1)["h"] == r["h"], F.lit(False))
                         | F.coalesce(F.get(rows, k + 1)["h"] == r["h"], F.lit(False)))
        return let(F.array_sort(F.transform(twice, lambda r: r["i"])), covered)

    def of_runs(runs: Column) -> Column:
        rows = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0).cast("long")).otherwise(let(rows, of_sorted))

    starts = F.sequence(F.lit(0), F.size(hashes) - RUN)
    runs = F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(RUN))))
    return F.when(F.size(hashes) <= RUN, F.lit(0).cast("long")).otherwise(let(runs, of_runs))


def ngrams(hashes: Column) -> Column:
    """Buckets of all words and of each word with the one before; ``hashes`` is a bound variable."""
    pairs = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i - 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")), pairs)


def counted(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target) over all rows of ``docs`` (text, trusted)."""
    grams = docs.select("trusted", F.explode(let(word_hashes(F.coalesce(F.col("text"), F.lit(""))), ngrams)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target"))


def ratios(counts: DataFrame) -> list[float]:
    """log(target / raw) of each bucket, both smoothed; 0 everywhere if nothing is trusted."""
    rows = counts.collect()
    raw, target = [1.0] * BUCKETS, [1.0] * BUCKETS
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if not any(r["target"] for r in rows):
        return [0.0] * BUCKETS
    all_raw, all_target = sum(raw), sum(target)
    return [log(t / all_target) - log(r / all_raw) for r, t in zip(raw, target)]


def base(text: Column, hashes: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, SPACE, "")) > 0)
    return {
        "n_words": F.size(hashes).cast("long"),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda own: (F.size(own) - F.size(F.array_distinct(own))).cast("long")),
        "n_repeat_words": repeated_words(hashes),
    }


def of_rank(scores: DataFrame, rank: int, ranges: int = RANGES, few: int = FEW) -> float:
    """The number at place ``rank`` (from 0) of the column ``score``, in order; ``scores`` is a stored table without nulls."""
    score = F.col("score")
    low, high, n = scores.agg(F.min(score), F.max(score), F.count("*")).first()
    while low < high and n > few:
        width = (high - low) / ranges
        at = F.least(F.floor((score - low) / width), F.lit(ranges - 1)) if width > 0 else (score > low).cast("int")
        parts = (scores.filter(score.between(low, high)).groupBy(at.alias("at"))
                 .agg(F.min(score).alias("low"), F.max(score).alias("high"), F.count("*").alias("n")).collect())
        for _, low, high, n in sorted(parts, key=lambda r: r["at"]):
            if rank < n:
                break
            rank -= n
    if low == high:
        return low
    return sorted(r[0] for r in scores.filter(score.between(low, high)).select(score).collect())[rank]


def quantile(scores: DataFrame, share: float) -> float | None:
    """As ``percentile``, in memory that does not grow with the rows."""
    n = scores.count()
    if not n:
        return None
    place = (n - 1) * share
    below, above = floor(place), ceil(place)
    low = of_rank(scores, below)
    high = low if above == below else of_rank(scores, above)
    return low if low == high else (above - place) * low + (place - below) * high


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of each row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "quality")
    good = sent(scratch(labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good")).distinct(), "good"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trusted = own.join(good, F.col("doc_id") == F.col("good"), "left").withColumn("trusted", F.col("good").isNotNull())
    weights = F.from_json(F.lit(json.dumps(ratios(counted(trusted)))), "array<double>")

    def measured(hashes: Column) -> Column:
        score = F.aggregate(ngrams(hashes), F.lit(0.0), lambda total, b: total + F.get(weights, b))
        score = F.when(F.size(hashes) == 0, 0.0).otherwise(score / (2 * F.size(hashes)))
        return F.struct(*(c.alias(name) for name, c in base(F.col("text"), hashes).items()), score.alias("score"))

    rows = own.select("doc_id", let(word_hashes(F.col("text")), measured).alias("m")).select("doc_id", "m.*")
    rows = written(rows, "quality")
    scores = scratch(rows.join(good, F.col("doc_id") == F.col("good"), "left_semi").select("score"), "scores")
    least = quantile(scores, QUANTILE)
    scratch.remove()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (rows.withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("score") >= F.lit(least if least is not None else 0.0))))
