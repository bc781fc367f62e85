"""Quality, language, toxicity: exact counts by brute force, models by held-out accuracy."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlore.llm import languages as lang
from faultlore.llm.common import slices
from faultlore.llm import quality as ql
from faultlore.llm.languages import held_out
from faultlore.llm import toxicity as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = "/root/testdata/sf0.01"


def counts(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {k for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


def test_quality_counts_and_verdict(spark, documents, labels):
    extra = [(9000, "a b c d e f g h a b c d e f g h"), (9001, "x " * 40), (9002, "é ö " * 9), (9003, "l\n\nl\n l\nl ")]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = dict(docs.collect())
    rows = ql.quality(docs, labels).collect()
    for r in rows:
        want = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_good_and_drops_bad(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    rows = ql.quality(docs, labels).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def taught_last(spark, n, learned, most):
    """``n`` ids, and those of them that come after the first ``most`` learnable ones by hash."""
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    found = [r[0] for r in ids.filter(learned).orderBy(F.xxhash64("doc_id")).collect()]
    return ids, sorted(found[most:])


def test_quality_counts_every_trusted_row(spark):
    ids, late = taught_last(spark, 20_300, F.lit(True), 20_000)
    plain, rare = " ".join(f"word{i}" for i in range(24)), " ".join(f"odd{i}" for i in range(24))
    docs = ids.withColumn("text", F.when(F.col("doc_id").isin(late), rare).otherwise(plain))
    rows = ql.quality(docs, ids.withColumn("quality", F.lit(1))).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in rows} == {True: 20_300}


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 0.999, 1.0])
def test_quantile_as_percentile(spark, tmp_path, share):
    at = str(tmp_path / "scores")
    spark.range(5000).select((F.when(F.col("id") % 3 == 0, -1.5).otherwise(F.rand(3) - 0.5)).alias("score")).write.parquet(at)
    scores = spark.read.parquet(at)
    assert ql.quantile(scores, share) == scores.agg(F.percentile("score", F.lit(share))).first()[0]
    n = scores.count()
    ordered = sorted(r[0] for r in scores.collect())
    for rank in (0, 1700, n - 1):
        assert ql.of_rank(scores, rank, ranges=7, few=5) == ordered[rank]
    assert ql.quantile(scores.filter("score > 9"), share) is None


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = lang.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixture_finds_both_languages(spark):
    rows = [(i, "the cat sat on the mat and the dog ran with that thing " * 3, "en") for i in range(40)]
    rows += [(100 + i, "die katze und der hund sind nicht im haus auf der straße ", "de") for i in range(40)]
    langs, p = lang.model(lang.trigram_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    mixed = "the cat sat on the mat and the dog ran die katze und der hund sind nicht im haus"
    got = lang.identified(spark.createDataFrame([(1, mixed), (2, rows[0][1])], "doc_id long, text string"), langs, p).collect()
    by = {r["doc_id"]: dict(x.split(":") for x in r["languages"].split(",")) for r in got}
    assert set(by[1]) == {"en", "de"} and 0.3 < float(by[1]["en"]) < 0.7 and set(by[2]) == {"en"}


POLISH = """Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem
i sumieniem i powinni postępować wobec innych w duchu braterstwa."""
FINNISH = """Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja
omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."""


def test_texts_of_many_languages_stay_and_unlearned_ones_go(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    parts = {}
    for r in docs.filter("length(text) > 1000").orderBy("doc_id").collect():
        parts.setdefault(r["lang"], r["text"][:1000])
    three, four = (" ".join(parts[k] for k in names) for names in (("en", "fr", "de"), ("en", "fr", "de", "es")))
    rows = [(-1, three, None), (-2, four, None), (-3, POLISH, None), (-4, FINNISH, None), (-5, parts["es"], None), (-6, "the", None)]
    all_docs = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in lang.in_known_language(all_docs).select("doc_id").collect()}
    assert {i for i in range(-6, 0) if i in kept} == {-1, -2, -5, -6}
    assert kept >= {r["doc_id"] for r in docs.select("doc_id", "text").collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    found = {r["doc_id"]: r["languages"] for r in lang.languages(all_docs).filter("doc_id < 0").collect()}
    assert {x.split(":")[0] for x in found[-1].split(",")} == {"en", "fr", "de"}
    assert {x.split(":")[0] for x in found[-2].split(",")} == {"en", "fr", "de", "es"}


def test_language_odd_rows(odd, empty):
    rows = lang.languages(odd).collect()
    assert len(rows) == odd.count() and lang.languages(empty).count() == 0
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    kept = lang.in_known_language(odd)
    assert kept.columns == odd.columns and not {1, 2, 3, 8} & {r["doc_id"] for r in kept.collect()}


def test_quality_odd_rows(spark, odd, empty):
    for labels in (spark.createDataFrame([(4, 1), (6, 1), (None, 1), (5, None)], "doc_id long, quality int"),
                   spark.createDataFrame([], "doc_id long, quality int")):
        rows = ql.quality(odd, labels).collect()
        assert len(rows) == odd.count() and all(not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 4))
        assert ql.quality(empty, labels).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    english = "the idiot is a stupid moron and the worthless loser is disgusting trash scum clown pathetic words " * 50
    docs = spark.createDataFrame([(english,)], "text string")
    return tx.character_model(tx.character_counts(docs))


@pytest.mark.parametrize("written, meant", [
    ("1d10t", "idiot"), ("stup1d", "stupid"), ("m0r0n", "moron"), ("w0rthl3ss", "worthless"), ("stuuuupid", "stupid"),
    ("i d i o t", "idiot"), ("p.a.t.h.e.t.i.c", "pathetic"), ("$cum", "scum"), ("tr@sh", "trash"), ("loser", "loser")])
def test_disguises_are_undone(model, written, meant):
    assert tx.restored(written, model) == meant


def test_viterbi_path_is_the_best_of_all_readings(model):
    def value(word):
        a = b = 0
        total = 0.0
        for c in word:
            s = tx._symbol(c)
            total, a, b = total + model[a, b, s], b, s
        return total + model[a, b, 0]

    # 1 is i or l, 0 is o: at equal channel costs the character model decides
    readings = [f"{x}d{y}ot" for x in "il" for y in "il"]
    assert tx.restored("1d10t", model) == max(readings, key=value)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    auc = np.mean([np.mean([(g < b) + 0.5 * (g == b) for g in good]) for b in bad])
    assert auc > 0.9 and np.mean([g < 0.5 for g in good]) > 0.98


def test_toxicity_learns_from_every_labelled_row(spark):
    ids, late = taught_last(spark, 21_000, ~held_out(5, 0), 16_000)
    assert len(late) > 400
    bad = F.col("doc_id").isin(late)
    text = F.when(bad, "we saw a zarkblat there").otherwise("we saw a house there")
    rows = tx.toxicity(ids.withColumn("text", text), ids.withColumn("toxic", bad.cast("int"))).filter("NOT held_out")
    assert {(r[0], r[1]) for r in rows.select(bad, "predicted").distinct().collect()} == {(True, 1), (False, 0)}


def test_curve_as_newton_steps_in_memory(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, toxic long")
    beta, own = tx._fitted(rows, ("a", "b"), "toxic"), np.hstack([np.ones((3000, 1)), x])
    p = 1 / (1 + np.exp(-own @ beta))
    assert np.abs(own.T @ (y - p) - np.array([1e-6, 0.1, 0.1]) * beta).max() < 1e-6
    assert (beta == tx._fitted(rows.repartition(7), ("a", "b"), "toxic")).all()


def test_disguised_toxic_text_scores_high(spark):
    clean = [f"the house number {i} stands near the river and many people like it" for i in range(300)]
    toxic = [f"you are a stupid idiot and a worthless moron number {i} near the river" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(clean + toxic)) + [(1000, "you are a stup1d 1d10t"), (1001, "i d i o t")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(360)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in tx.toxicity(docs, labels).collect()}
    assert got[1000] > 0.5 and got[1001] > 0.5 and max(got[i] for i in range(300)) < 0.5


SPELT = ["you are a i d i o t", "y o u i d i o t", "i d i o t.", "(m o r o n)!", "s t u p i d, m o r o n", "a 1 d ! 0 t", "he is | i d i o t |"]


def test_spelt_words_beside_other_words(spark):
    """A toxic word spelt beside single letters, signs and punctuation scores as if it were written."""
    clean = [f"you see that the house number {i} stands near a river and many people like it" for i in range(300)]
    toxic = [f"you are a stupid idiot and a worthless moron number {i} near the river" for i in range(60)]
    spelt = [(1000 + i, t) for i, t in enumerate(SPELT)] + [(2000, "y o u l i k e a r i v e r"), (2001, "a b c d, e f")]
    docs = spark.createDataFrame(list(enumerate(clean + toxic)) + spelt, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(360)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in tx.toxicity(docs, labels).collect()}
    assert all(got[1000 + i] > 0.5 for i in range(len(SPELT))), [(t, got[1000 + i]) for i, t in enumerate(SPELT)]
    assert got[2000] < 0.5 and got[2001] < 0.5 and max(got[i] for i in range(300)) < 0.5


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (5, None), (4, 0)], "doc_id long, toxic int")
    rows = tx.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert tx.toxicity(empty, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in tx.toxicity(odd, none).collect()} == {0.0}


def test_trigrams_do_not_depend_on_batches(spark, documents, monkeypatch):
    """The character model sees each text by itself, whatever it is read with."""
    whole = tx.character_counts(documents.coalesce(1))
    monkeypatch.setattr(tx, "slices", lambda batch: slices(batch, most=1))
    assert (tx.character_counts(documents.repartition(9)) == whole).all()
    odd = spark.createDataFrame([("ab",), ("",), (None,), ("é z",)], "text string")
    one = {k: int(v) for k, v in np.ndenumerate(tx.character_counts(odd)) if v}
    assert one[0, 1, 2] == 1 and one[0, 0, 1] == 1 and (2, 0, 27) not in one and (2, 0, 1) not in one


def test_a_long_run_of_letters_takes_time_in_proportion():
    model = tx.character_model(np.ones((28, 28, 28)))
    start = time.perf_counter()
    assert set(tx.restored("a" * 200_000, model)) == {"a"}
    assert time.perf_counter() - start < 30
