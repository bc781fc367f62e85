"""Languages of documents as mixtures of n-gram multinomials.

Training counts hashed character trigrams of each language over all labelled
texts.  A document is a mixture of languages: expectation-maximisation estimates
the proportions that explain its trigrams best; the set of languages is chosen
among the likeliest one, two, three and so on up to all by likelihood less a penalty
for each further language.  A set that cannot win, by a bound of what any mixture
reaches, is not evaluated.

Whether a text is in learned languages at all is decided against a background of
the languages' mean, flattened by its root: a text goes if the languages together
keep less than the asked share beside it and it gains more than a language's price.

The model has languages x ``BUCKETS`` numbers, however large the corpus is.

Edge cases.  Null texts and texts without a letter are ``und`` with score 0, as is
every text when nothing is labelled.  Rows with a null language train nothing,
rows with a null ``doc_id`` train and are not held out.  Repeated rows count each
time.  Of equally likely languages the first by name wins.  An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlore.llm.common import column, slices, texts
from faultlore.llm.words import mixed

BUCKETS = 1 << 15
#: Rounds of the estimate, and the price of a language in log n.
ROUNDS, PENALTY = 8, 3.0
SMOOTHING = 0.5
#: Text handled at once, in bytes; trigrams and their probabilities take about a hundred times as much memory.
SLICE = 1 << 18
_LETTER: np.ndarray | None = None


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the document's id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def trigrams(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index and bucket of every trigram with a letter in its middle; texts with a letter."""
    # a separator after each text; it can't be in a text's trigram, since it is no letter
    code = np.frombuffer("".join(t.lower() + "\n" for t in batch_texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t.lower()) + 1 for t in batch_texts])
    letter = _letters()[code]
    plain = np.where(letter, code, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    before = np.where(at > 0, plain[at - 1], 0)
    after = plain[at + 1] if len(at) else plain[:0]
    value = (before << np.uint64(42)) | (plain[at] << np.uint64(21)) | after
    of = np.searchsorted(np.cumsum(lengths), at, "right")
    return of, (mixed(value) & np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(of, minlength=len(batch_texts)) > 0


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs`` (text, lang) with a language."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, _, _ in slices(batch, most=SLICE):
                langs = np.array(column(part, "lang").to_pylist(), object)
                of, bucket, _ = trigrams(texts(part).to_pylist())
                for lang in sorted(set(langs)):
                    own = np.bincount(bucket[(langs == lang)[of]], minlength=BUCKETS)
                    sums[lang] = sums.get(lang, 0) + own
        for lang, own in sums.items():
            there = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int64()),
                                              pa.array(own[there], pa.int64())], names=["lang", "bucket", "n"])

    return (docs.filter("lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def model(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigrams' probabilities, BUCKETS x languages."""
    rows = counts.toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    at = np.searchsorted(np.array(langs, object), np.array(rows["lang"].to_pylist(), object)) if langs else []
    table[rows["bucket"].to_numpy(), at] += rows["n"].to_numpy()
    return langs, table / table.sum(0)


def _maximised(share: np.ndarray, p: np.ndarray, weight: np.ndarray, of: np.ndarray, starts: np.ndarray,
               rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) after so many rounds, and the texts' log likelihoods."""
    total = np.add.reduceat(weight, starts)
    for _ in range(rounds):
        joint = share[of] * p
        joint *= (weight / joint.sum(1))[:, None]
        share = np.add.reduceat(joint, starts) / total[:, None]
    return share, np.add.reduceat(weight * np.log((share[of] * p).sum(1)), starts)


def _counted(of: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct text indices; start, text, bucket and number of each one's distinct trigrams."""
    key, weight = np.unique(of * BUCKETS + bucket, return_counts=True)
    text, starts, of = np.unique(key // BUCKETS, return_index=True, return_inverse=True)
    return text, starts, of, key % BUCKETS, weight.astype(float)


def proportions(of: np.ndarray, bucket: np.ndarray, probabilities: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct text indices of ``of``, and each one's language proportions."""
    text, starts, of, bucket, weight = _counted(of, bucket)
    p = probabilities[bucket]
    n, langs = len(text), probabilities.shape[1]
    total = np.add.reduceat(weight, starts)
    price = PENALTY * np.log(total + 1)
    even, likelihood = _maximised(np.full((n, langs), 1 / langs), p, weight, of, starts, ROUNDS)
    # no mixture of the languages is likelier, as the logarithm is concave
    ratio = np.add.reduceat((weight / (even[of] * p).sum(1))[:, None] * p, starts).max(1) / total
    most = likelihood + total * np.log(np.maximum(ratio, 1)) + 1e-6
    order = np.argsort(-even, 1, kind="stable")
    best, best_value = np.zeros((n, langs)), np.full(n, -np.inf)
    for size in range(1, langs + 1):
        left = most - price * (size - 1) > best_value
        if not left.any():
            break
        rows = left[of]
        own_of = (np.cumsum(left) - 1)[of[rows]]
        own_starts = np.flatnonzero(np.diff(own_of, prepend=-1))
        chosen, own = order[left, :size], even[left]
        share = np.zeros_like(own)
        np.put_along_axis(share, chosen, np.maximum(np.take_along_axis(own, chosen, 1), 1e-6), 1)
        share /= share.sum(1, keepdims=True)
        share, likelihood = _maximised(share, p[rows], weight[rows], own_of, own_starts, 0 if size == 1 else ROUNDS // 2)
        value = likelihood - price[left] * (size - 1)
        better = value > best_value[left]
        at = np.flatnonzero(left)[better]
        best[at], best_value[at] = share[better], value[better]
    return text, best


def in_languages(of: np.ndarray, bucket: np.ndarray, probabilities: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The distinct text indices of ``of``, and whether the languages together make up ``least`` or more of each."""
    background = np.sqrt(probabilities.mean(1))
    _, share = proportions(of, bucket, probabilities)
    text, starts, of, bucket, weight = _counted(of, bucket)
    known = (share[of] * probabilities[bucket]).sum(1)
    both = np.stack([known, (background / background.sum())[bucket]], 1)
    alone = np.add.reduceat(weight * np.log(known), starts)
    share, likelihood = _maximised(np.full((len(text), 2), 0.5), both, weight, of, starts, ROUNDS)
    price = PENALTY * np.log(np.add.reduceat(weight, starts) + 1)
    return text, (share[:, 0] >= least) | (likelihood - alone <= price)


def identified(docs: DataFrame, langs: list[str], probabilities: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score and languages (``lang:share``, comma-joined, by share) of each row."""
    def identify(batches):
        for batch in batches:
            for part, _, _ in slices(batch, most=SLICE):
                n = len(part)
                names, scores, sets = ["und"] * n, [0.0] * n, [""] * n
                if langs:
                    of, bucket, _ = trigrams(texts(part).to_pylist())
                    text, share = proportions(of, bucket, probabilities) if len(of) else ((), ())
                    for i, own in zip(text, share):
                        order = np.argsort(-own, kind="stable")
                        names[i], scores[i] = langs[order[0]], min(1.0, float(own[order[0]]))
                        sets[i] = ",".join(f"{langs[k]}:{own[k]:.3f}" for k in order if own[k] > 0)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                     pa.array(sets, pa.string())], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "text").mapInArrow(identify, "doc_id long, lang_pred string, score double, languages string")


def in_known_language(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` (text, lang, doc_id, ...) of which learned languages together make up ``least`` or more.

    The rest is what the background explains better.  Rows that are ``und`` go; all
    columns stay as they are.
    """
    langs, probabilities = model(trigram_counts(docs.filter(~held_out(4, 2))))

    def keep(batches):
        for batch in batches:
            for part, _, _ in slices(batch, most=SLICE):
                mask = np.zeros(len(part), bool)
                if langs:
                    of, bucket, _ = trigrams(texts(part).to_pylist())
                    if len(of):
                        text, good = in_languages(of, bucket, probabilities, least)
                        mask[text] = good
                yield part.filter(pa.array(mask))

    return docs.mapInArrow(keep, docs.schema)


def languages(docs: DataFrame) -> DataFrame:
    """Predictions for all rows, learned from the rows with a language that aren't held out."""
    langs, probabilities = model(trigram_counts(docs.filter(~held_out(4, 2))))
    return (identified(docs, langs, probabilities).withColumn("held_out", held_out(4, 2))
            .select("doc_id", "held_out", "lang_pred", "score", "languages"))
