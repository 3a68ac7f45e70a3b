"""Words `[^\\x20\\x09-\\x0D]+` of many texts at once, as 64-bit hashes, and hashes of runs of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tessera.llm.common import mixed

_RANDOM = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, kept from call to call up to a few MB."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 21:
            _powers[base] = have
    return have[:n]


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, nothing else changed."""
    return _LOWER[raw]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: hash, first byte and end of every word, and the number of words of each text."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _WORD[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside[:-1]
    edge = at[at < len(raw)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), bool)
    after[:] = inside[1:]
    after[edge[edge > 0] - 1] = False
    if len(raw):
        after[-1] = False
    ends = np.flatnonzero(inside[:-1] & ~after) + 1
    n = np.diff(np.searchsorted(starts, at))
    return prefix_hashes(raw)(starts, ends), starts, ends, n


def prefix_hashes(raw: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the hashes of the bytes between given places."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_RANDOM[raw] * _powers_of(_BASE, len(raw)), out=total[1:])
    inverse = _powers_of(_INVERSE, len(raw) + 1)
    return lambda starts, ends: mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def runs(hashes: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text, and how many each text has."""
    each = np.maximum(0, n - size + 1)
    if len(hashes) < size:
        return np.zeros(0, np.uint64), each
    h = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        h += hashes[k : len(h) + k] * np.uint64(_RANDOM[k] | 1)
    first = np.cumsum(n) - n
    inside = np.zeros(len(hashes) + 1, np.int64)
    has = each > 0
    np.add.at(inside, first[has], 1)
    np.add.at(inside, first[has] + each[has], -1)
    return mixed(h[np.cumsum(inside)[: len(h)] > 0] + np.uint64(size)), each


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles of every text as ascending hashes end to end, and how many it has.

    A text with fewer than `size` words has one, its whole sequence; one without words has none.
    """
    hashes, _, _, n = words(lower(raw), at)
    h, each = runs(hashes, n, size)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        first = np.cumsum(n) - n
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = n[short] > k
            extra[there] += hashes[first[short[there]] + k] * np.uint64(_RANDOM[k] | 1)
        extra = mixed(extra + n[short].astype(np.uint64))
        h = np.insert(h, (np.cumsum(each) - each)[short], extra)
        each[short] = 1
    ends = np.cumsum(each)
    for a, b in zip((ends - each).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    of = np.repeat(np.arange(len(each)), each)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(each))
