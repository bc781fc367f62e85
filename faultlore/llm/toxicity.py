"""Toxicity of documents whose words may be disguised.

1. A character model (trigrams of a-z, other letters and the limits of words) is
   counted over all texts.
2. Words that look disguised (digits or signs among letters, letters said three
   times or more, letters spelt one by one) become lattices: each character is
   itself, a letter that it may stand for, or nothing.  The Viterbi path under
   channel costs and character model restores the word.  Letters spelt one by one
   are also split into words: every space is dropped or becomes the limit of a word,
   and the Viterbi path under the frequencies of known words and, for other words,
   the character model gives the words, all of which count.
3. Beginnings of words and whole words, as written and as restored, are weighed
   by log odds learned from labelled rows; a logistic curve over a text's largest
   weight, their sum and number makes the score.

All labelled rows that are not held out teach: words, log odds (three rows in four, by hash) and the curve (the
others), whose Newton steps are sums over a table.  The model keeps at most ``FEATURES`` features and ``VOCABULARY``
known words, which bounds what is broadcast.  The character model covers all texts and has a fixed size.

Edge cases.  Null and empty texts are scored from no feature.  Without labels of
both kinds every score is 0.  A row with a null ``doc_id`` is not held out, has no
label and is scored.  Repeated rows get the same score; of repeated labels the
larger counts.  An empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlore.llm.common import Scratch, column, sent, slices
from faultlore.llm.languages import held_out
from faultlore.llm.words import mixed, words

FEATURES, VOCABULARY = 50_000, 50_000
#: Bytes of the beginnings of words that are features, and the least evidence for one in standard deviations.
BEGINNINGS, EVIDENCE = (4, 5, 6), 4.0

# The letters that a character may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c"}
SEPARATORS = ".-*_ "
_COST_LEET, _COST_DROP, _COST_REPEAT, _COST_KEEP = -0.7, -0.5, -0.3, -14.0
#: Longest word of a spelt run, in letters, and the costs of a word that is not known and of a sign that is a limit.
LONGEST_WORD, _COST_UNKNOWN, _COST_LIMIT = 24, -6.0, -1.0

_BYTE = np.arange(256)
_LOW = _BYTE.astype(np.uint8)
_LOW[65:91] += 32
_LETTER = ((_LOW >= 97) & (_LOW <= 122))
_CORE = _LETTER | (_BYTE >= 128) | ((_BYTE >= 48) & (_BYTE <= 57))
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in STANDS_FOR] + [ord(c) for c in SEPARATORS if c != " "]] = True
_SIGN = _LEET & ~_CORE
_SIGN[[ord(c) for c in SEPARATORS]] = False
_SYMBOL = np.where(_LETTER, _LOW.astype(np.int64) - 96, np.where(_BYTE >= 128, 27, 0))


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all trigrams of symbols (28 x 28 x 28): a limit, a-z, another letter."""
    def count(batches):
        total = np.zeros(28 ** 3, np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch):
                # the bytes of one character beyond ASCII count as one letter
                first = np.flatnonzero((data < 128) | (data >= 192))
                # two limits around each text, so that no text knows its neighbours
                symbol = np.insert(_SYMBOL[data[first]], np.repeat(np.searchsorted(first, offsets), 2), 0)
                total += np.bincount((symbol[:-2] * 28 + symbol[1:-1]) * 28 + symbol[2:], minlength=28 ** 3)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["gram", "n"])

    rows = (docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))).toArrow()
    out = np.zeros(28 ** 3)
    out[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(28, 28, 28)


def character_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | two symbols before), smoothed by the one before."""
    two = counts.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    return np.log((counts + 20 * two[None]) / (counts.sum(2, keepdims=True) + 20))


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def restored(word: str, model: np.ndarray) -> str:
    """The likeliest reading of a disguised word, in lower case."""
    # arcs: (characters read, what they stand for, cost)
    word = word.lower()
    best: dict[int, dict[tuple[int, int], tuple[float, tuple | None]]] = {0: {(0, 0): (0.0, None)}}
    n = len(word)
    ends = list(range(1, n + 1))  # of the run of equal characters from each place
    for i in range(n - 2, -1, -1):
        if word[i] == word[i + 1]:
            ends[i] = ends[i + 1]
    for i in range(n):
        states = best.pop(i, {})
        c = word[i]
        arcs: list[tuple[int, str, float]] = []
        if c.isalpha():
            run = ends[i] - i
            arcs.append((1, c, 0.0))
            if run > 2:
                arcs.append((run, c, _COST_REPEAT * (run - 1)))
                arcs.append((run, c + c, _COST_REPEAT * (run - 2)))
        else:
            arcs += [(1, to, _COST_LEET) for to in STANDS_FOR.get(c, "")]
            arcs.append((1, "", _COST_DROP if c in SEPARATORS else _COST_KEEP))
        for state, (value, back) in states.items():
            for read, to, cost in arcs:
                total, at, path = value + cost, state, back
                for letter in to:
                    symbol = _symbol(letter)
                    total += model[at[0], at[1], symbol]
                    at, path = (at[1], symbol), (letter, path)
                there = best.setdefault(i + read, {})
                if at not in there or there[at][0] < total:
                    there[at] = total, path
    ends = [(value + model[a, b, 0], path) for (a, b), (value, path) in best.get(n, {}).items()]
    _, path = max(ends, key=lambda x: x[0], default=(0, None))
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


class Vocabulary:
    """Known words with their log frequencies, and all their beginnings."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values())
        self.value = {word: float(np.log(n / total)) for word, n in counts.items()}
        self.beginnings = {word[:k] for word in counts for k in range(1, len(word) + 1)}


def known_words(docs: DataFrame) -> Vocabulary:
    """The most frequent words of a-z in ``docs`` (text) that occur twice or more."""
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    rows = (docs.select(word).filter(F.col("word").rlike(f"^[a-z]{{1,{LONGEST_WORD}}}$")).groupBy("word")
            .agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(VOCABULARY)).toArrow()
    return Vocabulary(dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist())))


def spelt_words(letters: str, model: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """The likeliest words of a run of single letters and signs that stand for letters, in lower case."""
    letters = letters.lower()
    n, lost = len(letters), -np.inf
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(lost, 0, "")] * n

    def reach(to: int, value: float, start: int, word: str) -> None:
        if value > best[to][0]:
            best[to] = value, start, word

    for i in range(n):
        at = best[i][0]
        known = [("", 0.0)]
        one, two, unknown, word = 0, 0, at + _COST_UNKNOWN, ""
        for j in range(i, min(n, i + LONGEST_WORD)):
            c = letters[j]
            stands, cost = (c, 0.0) if c.isalpha() else (STANDS_FOR.get(c, ""), _COST_LEET)
            known = [(w + to, v + cost) for w, v in known for to in stands if w + to in vocabulary.beginnings]
            for w, v in known:
                if w in vocabulary.value:
                    reach(j + 1, at + v + vocabulary.value[w], i, w)
            symbol = _symbol(stands[:1])
            unknown += cost + model[one, two, symbol]
            one, two, word = two, symbol, word + stands[:1]
            reach(j + 1, unknown + model[one, two, 0], i, word)
        if not letters[i].isalnum():
            reach(i + 1, at + _COST_LIMIT, i, "")
    out, at = [], n
    while at:
        _, start, word = best[at]
        out.append(word)
        at = start
    return out[::-1]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the beginnings of words and of whole words, and their texts."""
    low = _LOW[data].astype(np.uint64)
    padded = np.concatenate([low, np.zeros(8, np.uint64)])
    value, out, texts = np.zeros(len(starts), np.uint64), [], []
    lengths = ends - starts
    for k in range(max(BEGINNINGS)):
        value = (value << np.uint64(8)) | padded[starts + k]
        if k + 1 in BEGINNINGS:
            there = lengths > k + 1
            out.append(mixed(value[there] * np.uint64(8) + np.uint64(k + 1)))
            texts.append(of[there])
    # whole words: again by 8 bytes each
    whole, left = lengths.astype(np.uint64), np.flatnonzero(lengths >= 3)
    at = starts.copy()
    while len(left):
        eight = np.zeros(len(left), np.uint64)
        for k in range(8):
            eight = (eight << np.uint64(8)) | np.where(at[left] + k < ends[left], padded[np.minimum(at[left] + k, len(padded) - 1)], 0)
        whole[left] = mixed(whole[left] ^ eight)
        at[left] += 8
        left = left[at[left] < ends[left]]
    there = lengths >= 3
    return np.concatenate([*out, whole[there]]), np.concatenate([*texts, of[there]])


def features(data: np.ndarray, offsets: np.ndarray, model: np.ndarray, known: dict[str, list[str]],
             vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of each distinct feature of a run of texts."""
    starts, ends, _, limits = words(data, offsets)
    of = np.searchsorted(limits, np.arange(len(starts)), "right") - 1
    if not len(starts):
        return of, np.zeros(0, np.uint64)
    core = _CORE[data]
    sums = np.concatenate([[0], np.cumsum(core)])
    next_core = np.flatnonzero(core)
    has = sums[ends] > sums[starts]
    first = next_core[np.minimum(sums[starts], len(next_core) - 1)] if len(next_core) else starts
    last = next_core[np.maximum(sums[ends] - 1, 0)] + 1 if len(next_core) else ends

    letter, leet = _LETTER[data], _LEET[data]
    follows = np.append(core[1:] | leet[1:], False)
    odd = leet & follows | np.append(leet[1:] & letter[:-1], False) & letter
    thrice = np.zeros(len(data), bool)
    low = _LOW[data]
    thrice[:-2] = letter[:-2] & (low[:-2] == low[1:-1]) & (low[:-2] == low[2:])
    letters = np.concatenate([[0], np.cumsum(letter)])
    odds = np.concatenate([[0], np.cumsum(odd | thrice)])
    suspect = (letters[ends] - letters[starts] >= 2) & (odds[ends] > odds[starts])
    # one letter or digit, perhaps with punctuation around it, or one sign that stands for a letter
    sign = (ends - starts == 1) & _SIGN[data][starts]
    single = has & (last - first == 1) & (letter | (leet & core))[np.minimum(first, len(data) - 1)]
    spelt = single | sign
    opens, closes = single & (first > starts), single & (ends > last)
    run = spelt[:-2] & spelt[1:-1] & spelt[2:] & (of[:-2] == of[2:]) if len(spelt) > 2 else np.zeros(0, bool)

    more: list[str] = []
    more_of: list[int] = []

    def add(word: str, text: int) -> None:
        if word not in known:
            if len(known) > 100_000:
                known.clear()
            # a run of letters: as one word, and as the words of its parts between punctuation
            parts = [p for part in word.split("\n") for p in spelt_words(part.replace(" ", ""), model, vocabulary)] if " " in word or "\n" in word else []
            known[word] = [w for w in {restored(word.replace("\n", " "), model): 0, **dict.fromkeys(parts)} if len(w) >= 3]
        more.extend(known[word])
        more_of.extend([text] * len(known[word]))

    whole = data.tobytes()
    for i in np.flatnonzero(suspect):
        add(whole[starts[i]:ends[i]].decode().rstrip(".,;:?!#%&*$"), int(of[i]))
    at = 0
    for i in np.flatnonzero(run):
        if i >= at:
            at = i + 2
            while at + 1 < len(spelt) and spelt[at + 1] and of[at + 1] == of[i]:
                at += 1
            if single[i:at + 1].any():
                signs = [whole[first[k]:last[k]] if single[k] else whole[starts[k]:ends[k]] for k in range(i, at + 1)]
                limits = ["\n" if closes[k] or opens[k + 1] else " " for k in range(i, at)] + [""]
                add("".join(s.decode() + limit for s, limit in zip(signs, limits)), int(of[i]))
            at += 1
    value, text = _hashes(data, first[has], last[has], of[has])
    if more:
        raw = [w.encode() for w in more]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
        value2, text2 = _hashes(np.frombuffer(b"".join(raw), np.uint8), bounds[:-1], bounds[1:], np.array(more_of))
        value, text = np.concatenate([value, value2]), np.concatenate([text, text2])
    return text, value


def _weights(learned: DataFrame, model: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes in order and their log odds, from (text, toxic)."""
    def count(batches):
        known: dict[str, list[str]] = {}
        for batch in batches:
            for part, data, offsets in slices(batch):
                toxic = np.array(column(part, "toxic").to_pylist(), np.int64)
                of, value = features(data, offsets, model, known, vocabulary)
                pairs = np.unique(np.stack([of.astype(np.uint64), value], 1), axis=0) if len(of) else np.zeros((0, 2), np.uint64)
                own, at, n = np.unique(pairs[:, 1], return_inverse=True, return_counts=True)
                bad = np.bincount(at, toxic[pairs[:, 0].astype(np.int64)], minlength=len(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(bad)],
                                                 names=["feature", "n", "bad"])

    rates = learned.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not rates["n"] or rates["bad"] in (0, rates["n"]):
        return np.zeros(0, np.uint64), np.zeros(0)
    share = rates["bad"] / rates["n"]
    grouped = learned.mapInArrow(count, "feature long, n long, bad long").groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    expected = F.col("n") * share
    evidence = (F.col("bad") - expected) / F.sqrt(expected * (1 - share) + 1)
    found = (grouped.withColumn("evidence", evidence).filter((F.col("evidence") > EVIDENCE) & (F.col("bad") >= 3))
             .orderBy(F.desc("evidence"), "feature").limit(FEATURES)).toArrow()
    feature = found["feature"].to_numpy().view(np.uint64)
    n, bad = found["n"].to_numpy(), found["bad"].to_numpy()
    weight = np.log((bad + 0.5) / (rates["bad"] + 1)) - np.log((n - bad + 0.5) / (rates["n"] - rates["bad"] + 1))
    order = np.argsort(feature)
    return feature[order], weight[order]


class Scorer:
    """Largest weight, sum of weights and number of weighty features of texts."""

    def __init__(self, model: np.ndarray, vocabulary: Vocabulary, feature: np.ndarray, weight: np.ndarray):
        self.model, self.vocabulary, self.feature, self.weight = model, vocabulary, feature, weight
        self.maybe = np.zeros(1 << 16, bool)  # drops most others before the search
        self.maybe[(feature & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.known: dict[str, list[str]] = {}

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, 3))
        of, value = features(data, offsets, self.model, self.known, self.vocabulary)
        if not len(self.feature) or not len(of):
            return out
        there = self.maybe[(value & np.uint64(0xFFFF)).astype(np.int64)]
        of, value = of[there], value[there]
        at = np.minimum(np.searchsorted(self.feature, value), len(self.feature) - 1)
        hit = self.feature[at] == value
        pairs = np.unique(np.stack([of[hit], at[hit]], 1), axis=0)
        weight = self.weight[pairs[:, 1]]
        np.maximum.at(out[:, 0], pairs[:, 0], weight)
        out[:, 1] = np.log1p(np.bincount(pairs[:, 0], weight, minlength=len(out)))
        out[:, 2] = np.log1p(np.bincount(pairs[:, 0], minlength=len(out)))
        return out


#: Summands are rounded to this part of 1 and added as whole numbers, so that sums do not depend on the order of tasks.
_PART = 2.0 ** -40


def _fitted(rows: DataFrame, names: tuple[str, ...], label: str, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps over a stored table; the constant comes first."""
    x = [F.lit(1.0), *map(F.col, names)]
    places = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    beta = np.zeros(len(x))
    penalty = ridge * np.eye(len(x))
    penalty[0, 0] = 1e-6

    def total(value: Column, name: str) -> Column:
        return F.sum(F.round(value / _PART).cast("decimal(20,0)")).alias(name)

    for _ in range(30):
        z = sum((x[i] * float(beta[i]) for i in range(1, len(x))), F.lit(float(beta[0])))
        p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
        sums = rows.withColumn("_p", p).agg(
            *(total(F.col("_p") * (1 - F.col("_p")) * x[i] * x[j], f"h{i}{j}") for i, j in places),
            *(total((F.col(label) - F.col("_p")) * own, f"g{i}") for i, own in enumerate(x))).first()
        hessian = np.zeros((len(x), len(x)))
        for i, j in places:
            hessian[i, j] = hessian[j, i] = float(sums[f"h{i}{j}"]) * _PART
        slope = np.array([float(sums[f"g{i}"]) * _PART for i in range(len(x))])
        step = np.linalg.solve(hessian + penalty, slope - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    model = character_model(character_counts(docs))
    scratch = Scratch(docs.sparkSession, "toxicity")
    taught = sent(scratch(labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(5, 0))
                          .groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic")), "labels"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))

    def learned(some: Column) -> DataFrame:
        return docs.filter(~held_out(5, 0) & some).join(taught, "doc_id").select("text", "toxic")

    vocabulary = known_words(learned(F.lit(True)))
    feature, weight = _weights(learned(part > 0), model, vocabulary)
    curve = None
    if len(feature):
        def measure(batches):
            scorer = Scorer(model, vocabulary, feature, weight)
            for batch in batches:
                for part, data, offsets in slices(batch):
                    x = scorer(data, offsets)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), column(part, "toxic")], names=["a", "b", "c", "toxic"])

        measured = scratch(learned(part == 0).mapInArrow(measure, "a double, b double, c double, toxic long"), "measured")
        if not measured.isEmpty():
            curve = _fitted(measured, ("a", "b", "c"), "toxic")
    scratch.remove()

    def score(batches):
        scorer = Scorer(model, vocabulary, feature, weight)
        for batch in batches:
            for part, data, offsets in slices(batch):
                if curve is None:
                    p = np.zeros(len(part))
                else:
                    p = 1 / (1 + np.exp(-np.clip(curve[0] + scorer(data, offsets) @ curve[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id").cast(pa.int64()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return (docs.mapInArrow(score, "doc_id long, score double, predicted int").withColumn("held_out", held_out(5, 0))
            .select("doc_id", "held_out", "score", "predicted"))
