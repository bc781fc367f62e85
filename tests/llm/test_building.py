"""Mixing, packing, the pipeline and the entry point."""

import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from faultlore.llm import mixing, packing
from tests.llm.test_duplicates import near_by_force

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_fill_up_and_reshare():
    got = mixing.targets([("b", 100), ("a", 10), (None, 100), ("c", 1000)])
    assert list(got) == ["a", "b", "c", None] and got["a"] == 20
    assert abs(sum(got.values()) - 1815) < 1e-6 and got["b"] == 200 and got[None] == 200
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0}


def test_hypergeometric_draws():
    rng = random.Random(1)
    draws = [mixing.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert 0 <= min(draws) and max(draws) <= 20
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


def test_quotas_are_exact():
    for shards in (1, 2, 7, 64):
        parts = mixing.split_quotas([4096, 17, 0, 900], shards, 5)
        assert [sum(p[i] for p in parts) for i in range(4)] == [4096, 17, 0, 900] and len(parts) == shards
        totals = [sum(p) for p in parts]
        assert max(totals) - min(totals) <= len(bin(shards))
    assert mixing.split_quotas([9, 9], 4, 3) == mixing.split_quotas([9, 9], 4, 3)


def test_mixture_reaches_its_targets(documents):
    rows = mixing.mixture_sizes(documents).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mixture_sizes(documents.repartition(5)).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    sums = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        own = sums.setdefault(source[r["doc_id"]], [0, 0, r["source_size"], r["target"]])
        own[0] += r["size"]
        own[1] += r["taken"]
    want = mixing.targets([(s, size) for s, (size, _, _, _) in sums.items()])
    for s, (size, taken, source_size, target) in sums.items():
        assert size == source_size and abs(taken - target) <= 0.5 and abs(target - want[s]) < 1e-6


def test_taken_against_a_plain_version(documents):
    """Each source's rows in their order, all of them as often as the target holds them and then the first words."""
    docs = mixing.placed(documents, "doc_id", "text", "source")
    rows = mixing._Rows(docs, 64, 17)
    by_source, want = {}, {}
    for r in rows.own.collect():
        by_source.setdefault(r["source"], []).append((r["block"], r["rank"], r["row"], r["doc_id"], r["size"]))
    goals = mixing.targets([(s, sum(x[4] for x in own)) for s, own in by_source.items()])
    for source, own in by_source.items():
        total = sum(x[4] for x in own)
        whole, left = divmod(round(goals[source]), total) if total else (0, 0)
        for *_, doc_id, size in sorted(own):
            want[doc_id] = whole * size + min(left, size)
            left -= min(left, size)
    assert {r["doc_id"]: r["taken"] for r in mixing.mixture_sizes(documents).collect()} == want


def test_taken_follows_the_tree(documents, monkeypatch):
    """Shards that draw less than their quotas take less."""
    want = sum(r["taken"] for r in mixing.mixture_sizes(documents).collect())
    whole = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: [[q // 2 for q in p] for p in whole(quotas, shards, seed)])
    assert 0 < sum(r["taken"] for r in mixing.mixture_sizes(documents).collect()) < 0.9 * want


def test_identical_rows_are_numbered(spark):
    docs = spark.createDataFrame([(1, "a b", "s")] * 700 + [(2, "a b", "s"), (None, "a b", None), (None, "a b", None)], "doc_id long, text string, source string")
    rows = mixing._Rows(mixing.placed(docs, "doc_id", "text", "source"), 4, 1)
    assert rows.own.select("block", "rank").distinct().count() == 703


def test_mixed_rows_are_the_sizes(documents):
    sizes = {r["doc_id"]: r["taken"] for r in mixing.mixture_sizes(documents).collect()}
    mixed = mixing.mixed_documents(documents, shards=4)
    assert mixed.columns == documents.columns and mixed.rdd.getNumPartitions() == 4
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == {k: v for k, v in sizes.items() if v}


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mixture_sizes(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(odd).count() > 0
    assert mixing.mixture_sizes(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_targets_end_inside_one_row_of_many_alike(spark):
    """Null ids, one repeated id and identical rows: every source gives its target, again in any order of the rows."""
    rows = [(None, f"null w{i} " * 40, "a") for i in range(60)] + [(i, f"own w{i} " * 40, "a") for i in range(30)]
    rows += [(5, f"same id {i} " * 30, "b") for i in range(80)] + [(None, "all alike " * 50, "c")] * 90
    rows += [(1000 + i, f"d{i} " * 70, "d") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {(r["doc_id"], len(WORD.findall(r["text"]))): r["source"] for r in docs.collect()}
    sums = {}
    for r in mixing.mixture_sizes(docs).collect():
        own = sums.setdefault(source[r["doc_id"], r["size"]], [0, r["target"]])
        own[0] += r["taken"]
    key = ["doc_id", "size", "source_size", "target", "taken"]
    want, again = (sorted(map(str, mixing.mixture_sizes(d).select(*key).collect())) for d in (docs, docs.repartition(7)))
    assert want == again
    words = {}
    for r in mixing.mixed_documents(docs, shards=4).collect():
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert words == {s: taken for s, (taken, _) in sums.items()}


def by_library(texts):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.encode_special_tokens = True
    return [np.array(e.ids + [0], "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


HARD = ["", " ", "  a  b ", "a \n b", "\n \n\tx  y", "don't 12 ab12 !?", "é ß 漢字 😀  z", " lead", "trail ", "a\x1c b", "x" * 5000, "word " * 3000]


def check_packing(rows, texts, capacity=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (doc_id, _), ids in zip(texts, by_library([t or "" for _, t in texts])):
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0  # no padding


def test_packing_round_trip(spark, documents):
    texts = [(r["doc_id"], r["text"]) for r in documents.limit(60).collect()] + list(enumerate(HARD, 10_000)) + [(20_000, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    check_packing(packing.packed_documents(docs).collect(), texts)


def test_added_tokens_as_the_library_finds_them(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|> " * 700, "<|endoftext|", "<|endof text|>",
             "a  <|endoftext|>  b", "ein <|ENDOFTEXT|> é<|endoftext|>ß", "<<|endoftext|>>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {i: np.array(e.ids + [0], "<u4") for i, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False))}
    assert 50256 in want[0]
    got = packing.packed_documents(docs).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {i: len(ids) for i, ids in want.items()}
    assert all(r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes()) for r in got)


def test_bins_of_any_length_take_a_fixed_count(spark):
    rng = random.Random(4)
    rows = [(i, 0, rng.randint(1, 100), 0, 0) for i in range(2000)]
    got = packing.packed(spark.createDataFrame(rows, packing.PIECES), capacity=100, workers=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == 2000
    for own in by.values():
        own.sort()
        k = {100 // n for _, n in own}
        assert len(k) == 1 and len(own) <= min(k) and all(own[i][0] + own[i][1] == own[i + 1][0] for i in range(len(own) - 1))
        assert own[0][0] == 0 and sum(n for _, n in own) <= 100


def test_packing_odd_rows(odd, empty):
    got = packing.packed_documents(odd).collect()
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in got if r["doc_id"] == 1] == [(0, 1, 1)]
    assert packing.packed_documents(empty).count() == 0


def test_pipeline_stages(spark, documents):
    """Each stage by its own input; the columns of documents until the last."""
    docs, names = documents, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact", "near", "mixing", "packing"]
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, ""), name)
        if name != "packing":
            assert docs.columns == documents.columns
    texts = {n: {r["doc_id"]: r["text"] for r in rows} for n, rows in inputs.items()}
    assert set(texts["exact"]) == {i for i, t in texts["language"].items() if re.search(r"[^\W\d_]", t or "")}
    first = {}
    for i, t in sorted(texts["exact"].items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert set(texts["near"]) == set(first.values())
    force = near_by_force(texts["near"], 80, 5)
    assert set(texts["mixing"]) == {i for i, (_, _, kept) in force.items() if kept}
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in inputs["packing"]}
    check_sequences = {}
    for r in docs.collect():
        check_sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 1024 for own in check_sequences.values())


def test_entry_without_the_subpackage(tmp_path):
    """The other queries are there when the pipeline's folders are gone."""
    import subprocess
    from pathlib import Path
    top = Path(__file__).resolve().parents[2]
    for name in ("faultlore", "checks"):
        (tmp_path / name).mkdir()
        for path in (top / name).rglob("*.py"):
            at = path.relative_to(top)
            if "llm" not in at.parts:
                (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
                (tmp_path / at).write_text(path.read_text())
    (tmp_path / "__spark_entry__.py").write_text((top / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q)"],
                          cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 90 and said[1] == "False"
