"""Word hashes and distinct word shingles of whole texts, vectorised over the bytes of an Arrow slice.

Words are maximal runs of bytes other than space and \\t\\n\\v\\f\\r; A-Z are lower-cased, all else stays.  A word's
hash is a polynomial over its bytes modulo 2**64, taken from one running sum over the slice, then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_STEP = U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, U(base), U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=U))
        _POWERS[:] = made
    return _POWERS


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each document the number of its first word (one more at the end)."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    gap = gaps[data]
    inside = ~gap
    first, last = inside.copy(), inside.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * power[:len(data)], dtype=U, out=run[1:])
    return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(U))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles in order, and where each document's begin (one more entry at the end).

    A document of 1 to size-1 words has its whole sequence as the only shingle; one without words has none.
    """
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    count = np.diff(first)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(bounds[-1], U)
    if len(h) >= size:
        rolled = h[:len(h) - size + 1].copy()
        for k in range(1, size):
            rolled = rolled * _STEP + h[k:len(h) - size + 1 + k]
        doc = np.repeat(np.arange(len(count)), count)
        fits = doc[:len(rolled)] == doc[size - 1:]
        out[np.repeat(count >= size, made)] = mix(rolled[fits])
    for d in np.flatnonzero((count > 0) & (count < size)):
        x = U(0)
        with np.errstate(over="ignore"):
            for w in h[first[d]:first[d + 1]]:
                x = x * _STEP + w
            out[bounds[d]] = mix(np.array([x ^ U(int(count[d]) << 56)], U))[0]
    return out, bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_hashes, but each document's distinct hashes, sorted."""
    h, bounds = shingle_hashes(data, offsets, size)
    keep = np.ones(len(h), bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
            np.not_equal(h[a + 1:b], h[a:b - 1], out=keep[a + 1:b])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], kept[bounds]
