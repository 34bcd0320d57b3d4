"""Word and shingle fingerprints over raw UTF-8, vectorised with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All arithmetic
is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The murmur3 finaliser: a bijection of 64-bit words."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _BASE)]))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """(hash of every word in order, first word of each row as n + 1 positions)."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~SEPARATOR[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    pointer = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), pointer
    at = np.flatnonzero(word)
    where = np.searchsorted(at, starts)
    lengths = np.diff(np.append(where, len(at)))
    inside = np.arange(len(at)) - np.repeat(where, lengths)
    letters = data[at]
    if lower:
        letters = LOWER[letters]
    values = _BYTE[letters]
    values *= _powers(int(lengths.max()))[inside]
    h = np.add.reduceat(values, where)
    return mix(h ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), pointer


def spans(hashes: np.ndarray, pointer: np.ndarray, width: int, salt: int = 0):
    """(start word, row, hash) of every run of ``width`` words that lies within a row."""
    n = np.diff(pointer)
    count = np.maximum(n - width + 1, 0)
    rows = np.repeat(np.arange(len(n)), count)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else count
    at = np.arange(int(count.sum())) - np.repeat(first - pointer[:-1], count)
    total = len(hashes) - width + 1
    if len(at) == 0 or total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(total, np.uint64)
    for k in range(width):
        h += hashes[k : k + total] * _STEP[(k + salt) % 64]
    return at, rows, mix(h[at] + np.uint64(width + 131 * salt))
