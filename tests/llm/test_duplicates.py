"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from faultlore.llm import exact, near, substrings
from faultlore.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"]
    base = [rng.choice(vocabulary) for _ in range(120)]
    out = []
    for i in range(160):  # copies of one text with ever more changes, and others
        own = list(base) if i < 100 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        for _ in range(i // 10 if i < 100 else 0):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append(" ".join(own))
    return out + out[95:105] + [t.upper() for t in out[:3]] + [t.replace(" ", "\n", 5) for t in out[100:103]]


def shingles(text, k=3):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)} if words else set()


def near_by_force(texts, percent=85, k=3):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


def test_near_duplicates(spark):
    for percent, k in ((85, 3), (80, 5)):
        texts = dict(enumerate(some_texts()))
        got = near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), percent, k)
        assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == near_by_force(texts, percent, k)


def test_blocks_find_what_pivots_miss(spark):
    """A chain whose ends are unlike, with blocks far smaller than its bucket."""
    old, near.BLOCK = near.BLOCK, 4
    try:
        words = [f"w{i}" for i in range(400)]
        texts = {i: " ".join(words[3 * i:3 * i + 200]) for i in range(60)}
        got = near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
        assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == near_by_force(texts)
    finally:
        near.BLOCK = old


def test_a_bucket_of_many_texts_that_are_not_linked(spark, monkeypatch):
    """Texts that share a passage, too unlike to be linked but for a few; blocks bounded by rows and by bytes."""
    monkeypatch.setattr(near, "BLOCK", 64)
    monkeypatch.setattr(near, "BLOCK_BYTES", 4000)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = {i: f"{passage} " + " ".join(f"q{rng.randrange(60)}" for _ in range(3 + i % 20)) for i in range(1200)}
    got = near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == near_by_force(texts)


def test_pruning_keeps_what_may_reach_the_threshold():
    assert [near.least_matches(0.85, 1e-6, k) for k in (28, 140)] == sorted(near.least_matches(0.85, 1e-6, k) for k in (28, 140))
    assert near.least_matches(0.85, 1e-6, 140) < 0.85 * 140 < 140


def test_near_odd_rows(odd, empty):
    got = near.near_duplicates(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert len(got) == odd.count()
    assert by[1] == [(0, 1, True)] and by[3] == [(0, 3, True)] and len(by[4]) == 2
    assert by[6][0][1:] == (6, True) and by[7][0][1:] == (6, False)
    assert near.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}


def test_exact_against_sql(spark, documents, odd):
    rows = documents.select("doc_id", "text").union(odd.filter("doc_id IS NOT NULL").selectExpr("doc_id + 100000", "text").distinct())
    table = rows.toArrow()
    con = duckdb.connect()
    con.register("documents", table)
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({exact.SQL})").fetchall())
    assert sorted(map(tuple, exact.exact_duplicates(rows, capacity=10).select(*names).collect())) == want


def test_exact_odd_rows(odd, empty):
    got = exact.exact_duplicates(odd).collect()
    assert len(got) == odd.count() and exact.exact_duplicates(empty).count() == 0
    assert {r["keep_id"] for r in got if r["doc_id"] in (1, 2)} == {1}


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS key").union(spark.range(5000).selectExpr("id AS key"))
    of = exact.directory(keys.distinct(), capacity=1000)
    sizes = keys.distinct().selectExpr(f"shiftrightunsigned(key, {64 - exact.DEEPEST}) AS entry").join(of, "entry").groupBy("bucket").count().collect()
    # small numbers share their first bits, so no depth splits them
    assert all(r["count"] <= 1000 or r["bucket"] >= 1 << exact.DEEPEST for r in sizes)
    assert len({r["bucket"].bit_length() for r in sizes}) > 1


def removed_by_force(texts, window=35):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    counts = Counter(tuple(w[j:j + window]) for w in words.values() for j in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = {k for j in range(len(w) - window + 1) if counts[tuple(w[j:j + window])] > 1 for k in range(j, j + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_windows(spark, documents):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for i in range(30):
        own = [f"r{rng.randrange(50)}" for _ in range(rng.randint(0, 80))]
        cut = rng.randrange(len(own) + 1)
        texts[1000 + i] = " ".join(own[:cut] + passage[rng.randrange(20):] + own[cut:])
    texts[2000], texts[2001] = "x " * 500, " ".join(f"q{i % 35}" for i in range(200))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = removed_by_force(texts)
    for cells in (27, 8):  # a sketch without room overestimates everything and loses nothing
        got = substrings.repeated_windows_removed(docs, cells_log2=cells)
        assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_windows_odd_rows(odd, empty):
    got = substrings.repeated_windows_removed(odd).collect()
    assert len(got) == odd.count() and substrings.repeated_windows_removed(empty).count() == 0
    long = [r for r in got if r["doc_id"] in (6, 7)]
    assert all(r["n_words"] == r["n_removed"] == 30_000 for r in long)
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] not in (6, 7))


def test_stages_keep_one_row_of_each_group(spark):
    """Null ids, repeated ids and repeated rows: one row of each group stays, no group is lost."""
    base = [f"w{i}" for i in range(60)]
    near_text, far = " ".join(base[:59] + ["other"]), " ".join(reversed(base))
    rows = [(1, "a clean text"), (1, "a clean text"), (1, "another text"), (None, "a text of its own"), (None, "said twice"),
            (None, "said twice"), (9, "said  by nine"), (None, "said by nine"), (None, " ".join(base)), (None, near_text), (7, far), (7, far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_number", F.lit(5)).repartition(3)

    def sorted_rows(df):
        assert df.columns == ["doc_id", "text", "row_number"]
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    once = [(1, "a clean text"), (1, "another text"), (None, "a text of its own"), (None, "said twice"), (9, "said  by nine"), (7, far)]
    assert sorted_rows(corpus_pipeline.exact_stage(spark, docs, "")) == sorted(once + rows[8:10], key=str)
    got = sorted_rows(corpus_pipeline.near_stage(spark, docs, ""))
    assert len(got) == 7 and [r for r in got if r[1] not in (" ".join(base), near_text)] == sorted(once, key=str)
    # on its own, the operator keeps all rows whose id names their component
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in near.near_duplicates(docs).collect())
