"""Words, shingles and rolling hashes of one text, vectorised with numpy.

A text is an array of UTF-8 bytes. The hash of bytes [s, e) is (Q[e] - Q[s]) * B^-s modulo 2^64, where Q sums the
coded bytes times powers of the odd base B, so that any set of spans is hashed without a loop.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(2 * len(_POWERS[0]), n, 1 << 14)
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit; each seed gives another order."""
    h = h ^ np.uint64((seed * 0xD6E8FEB86659FD93) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Of every k-byte string, by its start."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def joined_words(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space between, and their starts and ends there."""
    data = _LOWER[data] if lower else data
    space = _SPACE[data]
    starts, ends = word_spans(data)
    if not len(starts):
        return data[:0], starts, ends
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[ends[-1] :] = False
    out = np.where(space, np.uint8(32), data)[keep]
    size = ends - starts
    first = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    return out, first, first + size


def shingle_hashes(text: str | None, words: int, lower: bool = True) -> np.ndarray:
    """The sorted set of word shingles; a text of fewer words is one shingle, a text without words has none."""
    data, starts, ends = joined_words(as_bytes(text), lower)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(words, n)
    return np.unique(span_hashes(data, starts[: n - k + 1], ends[k - 1 :]))
