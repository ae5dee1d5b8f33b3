"""Word shingles of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of the longest words that are hashed by a polynomial modulo 2 ** 64: long words can be made whose polynomials agree
#: for any base.
LONGEST = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LOWER = bytes(range(256)).lower()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_factors = [np.zeros(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64, grown as texts need them."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
            _powers[k] = table
    return _powers[0], _powers[1]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place_factors(n: int) -> np.ndarray:
    """Odd numbers without pattern, one for each of n places: no two sets of few places have the same sum of them, so a run
    that repeats words is told from the same words in another order."""
    if len(_factors[0]) < n:
        _factors[0] = mixed(np.arange(2 * n, dtype=np.uint64), 1) | np.uint64(1)
    return _factors[0]


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words of text, A-Z lower-cased, words being split at white space
    of ASCII; of all words as one run if there are fewer; empty without words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)])
    hashed = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    for i in np.flatnonzero(ends - starts > LONGEST).tolist():
        hashed[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    n = min(words, len(hashed))
    size = len(hashed) - n + 1
    run, factors = np.full(size, n, np.uint64), _place_factors(n)
    for k in range(n):
        run += hashed[k : k + size] * factors[k]
    return np.unique(mixed(run))
