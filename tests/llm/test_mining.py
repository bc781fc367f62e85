"""Hard negatives and the source divergence audit against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from faultlore.llm import divergence, negatives


def negatives_by_force(rows, every=50, positives=5, limit=3, low=50, high=95, scale=256):
    """Results of (vec_id, label, embedding) rows, all pairs scored in plain integers."""
    valid = []
    for row, (vec_id, label, values) in enumerate(rows):
        if label is not None and values is not None and all(v is not None and math.isfinite(v) for v in values):
            own = [max(-(1 << 63), min((1 << 63) - 1, math.floor(scale * v))) for v in values]
            valid.append((row, vec_id, label, own))
    out = []
    for row, vec_id, label, values in valid:
        if vec_id is None or vec_id % every:
            continue
        scored = []
        for other, i, of, v in valid:
            if other != row and len(v) == len(values):
                score = sum(a * b for a, b in zip(values, v))
                scored.append((max(-((1 << 63) - 1), min((1 << 63) - 1, score)), i, of, other))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[3]))
        for score, i, of, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and low * score <= 100 * x[0] <= high * score]
            out.extend((vec_id, i, k + 1, x[1], score, x[0]) for k, x in enumerate(inside[:limit]))
    return sorted(out, key=repr)


def mined(spark, found, **options):
    df = spark.createDataFrame(found, "vec_id long, label int, embedding array<float>").repartition(3)
    clash = {c: df.vec_id for c in ("row", "id", "anchor", "values", "key", "score", "a", "r", "positive")}
    return sorted((tuple(r) for r in negatives.hard_negatives(df.withColumns(clash), **options).collect()), key=repr)


def vectors(seed, n, coarse=False):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    out = []
    for i in range(n):
        label = rng.randrange(4)
        own = [c + rng.gauss(0, 0.5) for c in centres[label if rng.random() < 0.7 else rng.randrange(4)]]
        out.append((i, label, [round(x) / 2 if coarse else struct_float(x) for x in own]))
    return out


def struct_float(x):
    """The nearest single-precision number, as the column holds it."""
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("coarse", [False, True])
def test_hard_negatives(spark, coarse):
    rows = vectors(1 + coarse, 260, coarse)
    for blocks in ({}, {"rows": 40, "anchors": 7}):
        assert mined(spark, rows, every=4, **blocks) == negatives_by_force(rows, every=4)
    assert mined(spark, rows, every=5, positives=2, negatives=9, low=10, high=100) == \
        negatives_by_force(rows, every=5, positives=2, limit=9, low=10, high=100)


def test_ties_repeated_rows_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    zero = [(i, i % 3, [0.0, 0.0]) for i in range(0, 30)]
    rows = zero + [
        (100, 0, [1.0, 1.0]), (100, 0, [1.0, 1.0]), (101, 0, [1.0, 1.0]), (102, 1, [0.75, 0.75]), (102, 1, [0.75, 0.75]),
        (103, 2, [0.5, 0.5]), (104, 1, [-1.0, -1.0]), (None, 1, [0.75, 0.75]), (None, 0, [1.0, 1.0]), (105, None, [1.0, 1.0]),
        (106, 1, None), (107, 1, [None, 1.0]), (108, 1, [nan, 1.0]), (109, 1, [inf, 1.0]), (110, 1, [1.0]), (150, 1, [1.0]),
        (151, 2, [0.75]), (152, 1, []), (200, 2, []), (201, 2, []), (202, 0, []), (250, 0, [-1.0, 0.5]), (300, 1, [3e38, 3e38]),
        (301, 1, [3e38, 1.0]), (302, 0, [2e38, -1.0]), (303, 0, [1e15, 1e15]), (350, 0, [1e15, 1e15])]
    rows = [(i, label, v and [x if x is None else struct_float(x) for x in v]) for i, label, v in rows]
    for blocks in ({}, {"rows": 5, "anchors": 2}):
        got = mined(spark, rows, every=50, **blocks)
        assert got == negatives_by_force(rows)
        assert got


def test_no_vectors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == []


WORDS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence_by_force(rows, documents=3, top=200):
    docs = [(lang or "", source or "", WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))) for text, lang, source in rows]
    in_docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        in_docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = {t for t, n in in_docs[lang].items() if n >= documents}
        of = {s: {t: n for t, n in c.items() if t in kept} for (x, s), c in counts.items() if x == lang}
        whole = Counter()
        for c in of.values():
            whole.update(c)

        def share(c, t):
            return 1 + 10 ** 9 * (c.get(t, 0) + 1) // (sum(c.values()) + len(kept))

        for source, c in of.items():
            pairs = []
            for other, d in of.items():
                if other != source:
                    pairs.append((-sum((share(c, t) - share(d, t)) ** 2 // share(d, t) for t in kept), other))
            terms = [(-((share(c, t) - share(whole, t)) ** 2 // share(whole, t)), t) for t in c if share(c, t) > share(whole, t)]
            for part, some in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out.extend((lang, source, part, item, -value, k + 1) for k, (value, item) in enumerate(some))
    return sorted(out)


@pytest.fixture
def corpus():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdefgÄé" for b in "klmnopqü"] + ["Ab", "AB", "x" * 300, "\U0001F600"]
    out = []
    for i in range(160):
        source = rng.choice(["s1", "s2", "s3", "S3", None])
        some = rng.sample(vocabulary, 30) if source != "s2" else vocabulary[:20]
        text = " ".join(rng.choice(some) + rng.choice(["", "7", "\x00", "_"]) for _ in range(rng.randint(0, 60)))
        out.append((text, rng.choice(["en", "de", None]), source))
    out += [(None, "en", "s1"), ("", "fr", "only"), (None, None, None), ("a b", "xx", "p"), ("\x00 @[`{\x7f", "xx", "q"), ("a b", "xx", "q")]
    return out + out[:5]


def test_source_divergence(spark, corpus):
    df = spark.createDataFrame(corpus, "text string, lang string, source string").repartition(4)
    clash = {c: df.text for c in ("term", "digest", "n", "docs", "p", "q", "value", "rank", "item", "part", "total")}
    for options in ({}, {"top": 7}, {"documents": 1, "top": 3}):
        want = divergence_by_force(corpus, **options)
        got = divergence.source_divergence(df.withColumns(clash), **options).collect()
        assert sorted(tuple(r) for r in got) == want


def test_digests_that_collide_are_split(spark, corpus):
    def few_digests(term):
        return len(term) % 3

    df = spark.createDataFrame(corpus, "text string, lang string, source string")
    got = divergence.source_divergence(df, of=few_digests).collect()
    assert sorted(tuple(r) for r in got) == divergence_by_force(corpus)


def test_divergence_of_odd_rows_by_sql(spark, odd, empty):
    docs = odd.select("text", "lang", "source").toPandas()
    documents = docs  # noqa: F841
    want = duckdb.sql(divergence.SQL.replace("FROM documents", "FROM docs")).fetchall()
    got = divergence.source_divergence(odd)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert divergence.source_divergence(empty).collect() == []


def test_long_texts_are_read_in_parts():
    text = (" ".join(f"w{chr(97 + i % 26)}ß" for i in range(700_000)) + " end").encode()
    assert divergence._terms(text) == Counter(divergence.TERM.findall(text))
    assert divergence._terms(b"a" * (3 << 20)) == {b"a" * (3 << 20): 1}
