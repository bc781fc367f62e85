"""Personal data and secrets against plain matching of the base patterns."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from faultlore.llm import pii
from faultlore.llm import secrets as sec


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]
SECRET = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: True),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m) >= 16),
]
TEXTS = [
    None, "", "a@b.c@d.e x%y@z.w..q é@é", "1.2.3.4.5.6.7.8 300.1.1.1 00000000001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (555) 123-4567. +12", "ééé x@y.zz 😀 10.0.0.1", "9" * 20_000, "a." * 20_000 + "@b.c", "+" + "1" * 20_000, "x@" + "a." * 20_000 + "b",
    "TOKEN: 'abcdefghijkl' password=short ſecret=abcdefghijklmn api_key = \"A/b+c=d.e-f_g\"", "AKIA" + "Z" * 14 + " AKIAZ", "0123456789abcdef" * 3,
]


def base(text, patterns):
    out = []
    for kind, (name, pattern, good) in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            if name == "assign" and len(m.group(2)) < 12:
                continue
            if good(m.group()):
                out.append((m.start(), kind, m.end()))
    return ",".join(f"{patterns[k][0]}:{a}:{b}" for a, k, b in sorted(out))


@pytest.mark.parametrize("operator, patterns", [(pii.personal_data, PERSONAL), (sec.secrets, SECRET)])
def test_base_spans(spark, documents, operator, patterns):
    rows = [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {r["doc_id"]: base(r["text"], patterns) for r in docs.collect()}
    for r in operator(docs).collect():
        said = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), r["doc_id"]
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
        for name, _, _ in patterns:
            assert r[f"n_{name}"] == len(re.findall(rf"\b{name}:", said))


@pytest.mark.parametrize("operator", [pii.personal_data, sec.secrets])
def test_odd_rows(odd, empty, operator):
    got = operator(odd).collect()
    assert len(got) == odd.count() and all(r["spans"] == "" for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert operator(empty).count() == 0


def test_disguised_mail_becomes_a_span(spark):
    rows = [(i, f"mail me: user{i} (at) host (dot) com or user{i}@host.com") for i in range(30)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_email"] == 1 and r["spans"].count("email:") == 2 for r in got)


def test_reliabilities_follow_agreement():
    patterns = [(0, (1, 1, 1, 1, 0, 1), 500), (0, (-1, -1, -1, 0, -1, -1), 500), (0, (1, 1, 1, 0, -1, 1), 20)]
    p = pii.reliabilities(patterns)
    assert p[0, (1, 1, 1, 1, 0, 1)] > 0.99 and p[0, (-1, -1, -1, 0, -1, -1)] < 0.01 and p[0, (1, 1, 1, 0, -1, 1)] > 0.5


def entropy(text):
    from math import log2
    return -sum(text.count(c) / len(text) * log2(text.count(c) / len(text)) for c in set(text))


def test_windows_equal_counting_each_anew():
    import random
    rng = random.Random(3)
    for _ in range(50):
        word = "".join(rng.choice("abcdef0123456789xyz") for _ in range(60))
        for name, (alphabet, least) in sec.CLASSES.items():
            hot = {k for a, b in sec.hot_windows(word, alphabet, least) for k in range(a, b)}
            want = {k for i in range(len(word) - 19) if set(word[i:i + 20]) <= alphabet and entropy(word[i:i + 20]) >= least - 1e-9
                    for k in range(i, i + 20)}
            assert hot == want, name


def test_entropy_finds_keys_and_spares_the_harmless():
    assert sec.scanned("key q7Zt2Lp9XvB4mN8cR1sWkD3f end")[1]
    for text in ("f47ac10b-58cc-4372-a567-0e02b2c3d479", "/usr/local/lib/python3.11/site-packages/numpy1", "internationalizationalism",
                 "2024-01-01-2024-12-31-0000", "www.a1b2c3d4e5f6g7h8.example.com", "A" * 40):
        assert not sec.scanned(text)[1], text


def test_entropy_alone_decides_on_keys():
    """Keys with one digit, with one run of digits or with letters alone."""
    for key in ("qZtLpXvBmNcRsWkDfGh7", "QzTlPx4827VbNmCrSwKd", "qZtLpXvBmNcRsWkDfGhJ", "kXwQzRtYpLmNbVcDsFgH", "zq7xkvjwpmhtbnrcdlgf"):
        assert sec.scanned(f"a {key} b")[1] == [(2, 22)], key
    for text in ("theQuickBrownFoxJumpedOver", "INTERNATIONAL_BUSINESS-MACHINES", "Quick-Brown-Foxes/jumping_over.lazy", "abcdefghijklmnopqrst"):
        assert not sec.scanned(text)[1], text


def test_random_keys_are_found():
    import random
    import string
    rng = random.Random(8)
    signs = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(signs) for _ in range(n)) for n in (20, 24, 32) for _ in range(1000)]
    hot = [k for k in keys if any(sec.hot_windows(k, *own) for own in sec.CLASSES.values())]
    assert len(hot) > 2900 and np.mean([bool(sec.scanned(k)[1]) for k in hot]) > 0.99


def test_spans_of_many_numbers_across_chunks(spark):
    """More matches than are gathered at a time, with spans in the first and the last of them."""
    text = "4111 1111 1111 1111 " + " ".join(f"n{i}" for i in range(10, 1500)) + " tel +49 30 1234567 x@y.org"
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at, mail = text.index("+49"), text.index("x@y")
    assert (row["n_card"], row["n_phone"], row["n_email"]) == (1, 1, 1)
    assert {"card:0:19", f"phone:{at}:{at + 14}", f"email:{mail}:{mail + 7}"} <= set(row["spans"].split(","))


def test_paths_as_by_their_pattern():
    """The plain check agrees with the pattern it stands for, which takes quadratic time."""
    pattern = re.compile(r"[./]*([a-z0-9_.-]+/)+[a-z0-9_.-]*")
    rng = random.Random(3)
    for _ in range(30_000):
        word = "".join(rng.choices("a.b/./-A_"[:rng.choice((4, 6, 9))], k=rng.randint(1, 9)))
        assert sec.is_path(word) == (pattern.fullmatch(word) is not None), word


def test_spans_inside_base_spans_are_not_added():
    rng = random.Random(4)
    for _ in range(200):
        key = "".join(rng.choices("abcdef0123456789", k=rng.randint(10, 60)))
        text = " ".join(rng.choice([f"token={key}", key, f"AKIA{key.upper()}", f"{key}/{key}Zq9", "a word"]) for _ in range(6))
        base, more = sec.scanned(text)
        assert base == sorted(base) and not any(a <= low and high <= b for a, _, b in base for low, high in more)


def test_long_texts_take_time_in_proportion():
    """A megabyte of keys, of paths, of dots: each within seconds."""
    rng = random.Random(5)
    keys = " ".join("token=" + "".join(rng.choices("abcdefXYZ0123456789", k=30)) for _ in range(28_000))
    for text in (keys, "./" * 500_000, "." * 1_000_000, "a/" * 500_000, "a" * 1_000_000, "aB" * 500_000):
        start = time.perf_counter()
        sec.scanned(text)
        assert time.perf_counter() - start < 20
