"""64-bit hashes of words and of runs of words, for a whole batch of texts at once.

Words are runs of bytes other than ASCII white space, so the same as
``[^\\x20\\x09-\\x0D]+`` on the characters.  A word's hash is a polynomial in its
bytes, taken from prefix sums modulo 2^64 and then mixed; a run's hash is a
polynomial in the hashes of its words.  Both depend on the content alone.
"""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_RUN_BASE = np.uint64(0xD6E8FEB86659FD93 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) < n:
        size = max(n, _CHUNK)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        known = _POWERS[int(base)] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return known[0][:n], known[1][:n]


def _polynomials(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, ...]:
    """Starts and ends (bytes) and hashes of all words, and each text's range in them.

    ``offsets`` are the texts' limits in ``data``; text i has the words
    ``limits[i]`` to ``limits[i + 1]``.  ``lower`` lower-cases A-Z.
    """
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin, end = ~space, ~space
    begin[1:] &= space[:-1] | first[1:-1]
    end[:-1] &= space[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # chunks of whole words
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK, "right")))
        low, high = starts[at], ends[to - 1]
        part = data[low:high]
        values = _VALUES[_LOWER[part] if lower else part]
        hashes[at:to] = _polynomials(values, starts[at:to] - low, ends[at:to] - low, _BASE)
        at = to
    return starts, ends, mixed(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of ``length`` consecutive words, over the limits of texts too."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for low in range(0, n, _CHUNK):
        high = min(n, low + _CHUNK)
        starts = np.arange(high - low)
        out[low:high] = _polynomials(hashes[low:high + length - 1], starts, starts + length, _RUN_BASE)
    return mixed(out)


def starts_of_runs(limits: np.ndarray, n: int, length: int) -> np.ndarray:
    """Whether a run of ``length`` words from word i lies in one text, for each start of ``runs``."""
    inside = np.ones(max(0, n - length + 1), bool)
    if length > 1:
        for limit in limits[1:-1]:
            inside[max(0, limit - length + 1):limit] = False
    return inside
