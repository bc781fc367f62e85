"""Jaccard join against brute force."""

import random

import numpy as np
import pytest

from faultlore.llm import jaccard
from tests.llm.test_duplicates import near_by_force, some_texts


def joined(df, **options):
    return {r["doc_id"]: tuple(r)[1:] for r in jaccard.jaccard_join(df, **options).collect()}


def texts_with_edits():
    """Groups around one text, each copy with its own changes; short texts, which share subsets; passages in many texts."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"]
    out = []
    for length in (11, 14, 20, 40, 90, 300):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for i in range(14):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, length // 60))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            cut = rng.choice((0, 0, 1, length // 30))
            out.append(" ".join(own[cut:] + [rng.choice(vocabulary) for _ in range(rng.choice((0, 0, 1, length // 50)))]))
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(1, 6))]) for _ in range(40)]
    return out + some_texts() + ["", " ", "a", "A", "a b", "a b c"]


@pytest.mark.parametrize("percent, shingle, hot", [(90, 3, 64), (90, 3, 2), (70, 2, 3)])
def test_jaccard_join(spark, percent, shingle, hot):
    texts = dict(enumerate(texts_with_edits()))
    got = joined(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), percent=percent, shingle=shingle, hot=hot)
    assert got == {i: x[:2] for i, x in near_by_force(texts, percent, shingle).items()}


def test_linked_sets_show_in_a_segment_or_its_neighbourhood():
    """Whatever either set skips, some probe finds the other."""
    rng = np.random.default_rng(3)
    for percent in (90, 80, 70):
        bands = jaccard.Bands(percent)
        for _ in range(300):
            size = int(rng.integers(9, 400))
            one = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            drop = int(rng.integers(0, max(1, size * (100 - percent) // percent) + 1))
            two = np.unique(np.concatenate([rng.permutation(one)[drop:], rng.integers(0, 1 << 64, int(rng.integers(0, drop + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(one, two))
            if 100 * both < percent * (len(one) + len(two) - both):
                continue
            small, large = sorted((one, two), key=len)
            band = bands.roles(len(small))[0] if len(small) >= bands.starts[0] else None
            if band is None:
                assert len(small) == len(large)
                continue
            assert band in bands.roles(len(large))
            segments = bands.segments(band)
            assert len(one) + len(two) - 2 * both < bands.needed(len(large), band) <= segments
            limits, sums, keys = jaccard._subsets(large, band, segments)
            other_limits, other_sums, other = jaccard._subsets(small, band, segments)
            shared = np.flatnonzero(keys == other)
            costly = {int(s): 1000 for s in rng.permutation(segments)[:int(rng.integers(0, segments + 1))]}
            skipped, widened = jaccard.allocation(np.diff(limits), segments - bands.needed(len(large), band), costly)
            less = jaccard._less_one(large, band, limits, sums, np.array(widened, np.int64))
            neighbours = jaccard._less_one(small, band, other_limits, other_sums, np.arange(segments))
            found = set(shared) - set(skipped) or np.isin(less, other).any()
            found = found or np.isin(keys[widened], neighbours).any()
            assert found


def test_bits_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    for size in (9, 300, 511, 512, 513, 5000):
        one = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        for change in (0, 1, 5, size // 9):
            two = np.unique(np.concatenate([one[change:], rng.integers(0, 1 << 64, rng.integers(0, 2 * change + 1), dtype=np.uint64)]))
            bits = jaccard.folded([jaccard.parity(one), jaccard.parity(two)])
            differ = int(jaccard._differ(bits[0], bits[1]))
            assert differ <= len(np.setxor1d(one, two)) and (differ > 0 or change == 0)


@pytest.mark.parametrize("block, rows, size", [(3, 2, 1 << 20), (7, 100, 300)])
def test_large_buckets_inside_small_blocks(spark, monkeypatch, block, rows, size):
    """A chain whose ends are unlike and copies of one text with changes of their own, every bucket counting as large."""
    for name, value in (("BLOCK", block), ("TEXTS", rows), ("BLOCK_BYTES", size)):
        monkeypatch.setattr(jaccard, name, value)
    words_of = [f"w{i}" for i in range(400)]
    rng = random.Random(9)
    texts = {i: " ".join(words_of[2 * i:2 * i + 200]) for i in range(60)}
    for i in range(60, 110):
        own = [f"b{k}" for k in range(150)]
        for _ in range(2):
            own[rng.randrange(150)] = f"x{i}"
        texts[i] = " ".join(own)
    got = joined(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), hot=2)
    assert got == {i: x[:2] for i, x in near_by_force(texts, 90).items()}


def test_odd_rows_of_the_join(odd, empty):
    df = jaccard.jaccard_join(odd)
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    got = sorted(map(tuple, df.collect()), key=repr)
    long = got[-4][1]
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 4, 4), (4, 4, 4), (5, 4, 5), (None, 3, None), (None, 0, None),
                          (6, 29998, 6), (7, 29998, 6), (8, 1, 8)], key=repr), long
    assert jaccard.jaccard_join(empty).collect() == []


def test_a_bucket_of_many_texts_that_are_not_linked(spark):
    """Short texts around one passage: subsets are shared by hundreds, so they are skipped or compared inside blocks."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(16))
    texts = {i: f"{passage} " + " ".join(f"q{rng.randrange(40)}" for _ in range(2 + i % 3)) for i in range(700)}
    got = joined(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert got == {i: x[:2] for i, x in near_by_force(texts, 90).items()}
