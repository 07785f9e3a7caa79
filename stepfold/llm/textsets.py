"""Sets of word shingles as 64-bit hashes, computed by numpy over whole blocks of texts."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random number for each byte; capital ASCII letters have those of the small ones.
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, _UNBASE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(h, u) such that (h[e] - h[s]) * u[s] depends on the bytes from s to e alone."""
    up, down = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.add.accumulate(table[data] * up[:-1], out=h[1:])
    return h, down


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, ASCII letters in lower case, and how many words each row has."""
    n = len(starts) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    before = np.concatenate([[False], word[:-1]]) & ~cut[:-1]
    after = np.concatenate([word[1:], [False]]) & ~cut[1:]
    first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    h, down = prefix_hashes(data, LOWER)
    hashes = mix((h[last] - h[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(first, starts))


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, end to end, and how many each has.

    A shingle is `size` consecutive words; a row of fewer words has them all as one, a row without words has none.
    """
    words, counts = word_hashes(data, starts)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(row)) + np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n)
    own = np.minimum(counts, size)[row]
    h = own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        has = own > k
        h[has] = mix(h[has] * np.uint64(0xFF51AFD7ED558CCD) + words[at[has] + k])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(counts))
