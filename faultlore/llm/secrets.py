"""Secrets: fixed patterns, and windows of high entropy.

Beside three fixed patterns, every run of 20 or more characters that a key may
consist of is a candidate.  For each character class that covers it (digits and
a-f, letters and digits, base 64) a window of 20 characters slides over it; the
counts of its characters, and from them its Shannon entropy, change by the one
that enters and the one that leaves.  The windows at or above the class's threshold
join into spans of kind ``entropy``.  What the allow-list knows as harmless is
suppressed: identifiers with dashes, addresses and paths, numbers, and words in
lower case, capitalised or in upper case with their compounds.  Nothing else but
the entropy decides.

Edge cases.  Null and empty texts have no span: counts 0, ``spans`` empty.  Repeated
rows and null ids are scanned like others.  Texts are scanned whole, in time
proportional to their length.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from faultlore.llm.common import column, slices, texts

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
WINDOW = 20
#: Per character class: its characters, and the least entropy of a window in bits.
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 3.0),
    "alnum": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 3.6),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 3.9),
}
#: Whole candidates that are harmless.
_WORD = r"(?:[A-Z]?[a-z]+|[A-Z]+|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})+)"  # the last as in capitalisedWords
ALLOWED = re.compile(r"""
      [0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}    # identifiers
    | [0-9+/_=.-]+                                          # numbers, dates, rulers
    | WORD([+/_=.-]+WORD)*                                  # words and compounds of words
    | ([A-Za-z0-9_-]+\.)+[A-Za-z]{2,}(/[A-Za-z0-9_.=-]*)*   # hosts
    | .*(EXAMPLE|example|placeholder|x{6,}|X{6,}).*         # said to be none
""".replace("WORD", _WORD), re.X)
_PATH = re.compile(r"[a-z0-9_./-]+")
_BELOW = re.compile(r"\./\.*$")
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def hot_windows(word: str, alphabet: frozenset[str], least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of ``word``, all in the alphabet, whose entropy is ``least`` bits or more."""
    log = [0.0] + [n * log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, outside, out = 0.0, 0, []
    for i, c in enumerate(word):
        n = counts.get(c, 0)
        counts[c], total = n + 1, total + log[n + 1] - log[n]
        outside += c not in alphabet
        if i >= window:
            c = word[i - window]
            n = counts[c]
            counts[c], total = n - 1, total + log[n - 1] - log[n]
            outside -= c not in alphabet
        # entropy = log2(window) - sum(n log2 n) / window
        if i >= window - 1 and not outside and log2(window) - total / window >= least - 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = out[-1][0], i + 1
            else:
                out.append((start, i + 1))
    return out


def is_path(word: str) -> bool:
    """Whether ``word`` is one or more named folders, each ended by a slash, and perhaps a name, after any dots and slashes."""
    if not _PATH.fullmatch(word):
        return False
    rest = word.lstrip("./")
    if "/" in rest:
        return "//" not in rest
    return _BELOW.search(word[:len(word) - len(rest)]) is not None


def allowed(word: str) -> bool:
    return is_path(word) or ALLOWED.fullmatch(word) is not None


def scanned(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind, end) in order, and the spans that entropy adds."""
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    starts = [low for low, _, _ in base]
    ends = list(accumulate((high for _, _, high in base), max))  # the farthest end of the spans up to each
    more: set[tuple[int, int]] = set()
    for m in _CANDIDATE.finditer(text):
        word = m.group()
        if allowed(word):
            continue
        spans = sorted(s for alphabet, least in CLASSES.values() for s in hot_windows(word, alphabet, least))
        joined: list[tuple[int, int]] = []
        for low, high in spans:
            if joined and low <= joined[-1][1]:
                joined[-1] = joined[-1][0], max(high, joined[-1][1])
            else:
                joined.append((low, high))
        for low, high in joined:
            low, high = low + m.start(), high + m.start()
            upto = bisect_right(starts, low)
            if not upto or ends[upto - 1] < high:
                more.add((low, high))
    return base, sorted(more)


KINDS = "assign", "access", "hex", "entropy"


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row of ``docs`` (doc_id, text); positions are code points, ends exclusive."""
    def scan(batches):
        for batch in batches:
            for part, _, _ in slices(batch):
                counts, digests, spans = ([], [], []), [], []
                for text in texts(part).to_pylist():
                    base, more = scanned(text)
                    for kind, out in enumerate(counts):
                        out.append(sum(k == kind for _, k, _ in base))
                    digests.append(hashlib.sha256(_said(base).encode()).hexdigest())
                    spans.append(_said(sorted(base + [(low, 3, high) for low, high in more])))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
                     pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, RESULT)
