"""Vectorised word hashes: one pass over the bytes of a text, no Python loop per word."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Bytes with A-Z folded to a-z, plus one so that no byte counts as nothing.
FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
FOLD[65:91] += np.uint64(32)


def _power(n: int):
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base of the word hashes and of its inverse."""
    up, down = _power(n)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scrambler (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(buf: np.ndarray, separators: np.ndarray = SPACE):
    """Starts and ends of the runs of non-separator bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~separators[buf]
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def hash_words(raw: bytes, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every word of a UTF-8 text, A-Z folded, and the bytes where it starts and ends."""
    buf = np.frombuffer(raw, np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _power(len(buf) + 1)
    start, end = spans(buf, separators)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(FOLD[buf] * up[:len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end


def word_hashes(text: str, separators: np.ndarray = SPACE) -> np.ndarray:
    """64-bit hash of every word of a text, A-Z folded, in order."""
    return hash_words(text.encode("utf-8", "surrogatepass"), separators)[0]


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words; fewer words give one shingle, none gives none."""
    if len(words) == 0:
        return words
    if len(words) < n:
        n = len(words)
    out = words[:len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x100000001B3) + words[k:len(words) - n + 1 + k])
    return out
