"""Runs of byte windows that share a minimizer.

Every window of `length` bytes has a minimizer, the least-hashed of its grams of GRAM bytes, the leftmost
if several hash alike; grams known to be frequent come last. Equal windows have equal minimizers at equal places, so windows that may be equal
can be brought together by the hash of that gram alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shingles import mixed

GRAM = 32
#: Windows that are looked at together; places must fit the 24 bits kept for them.
_BLOCK = 1 << 20
_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
#: Entries of the table of frequent grams.
_TABLE = 1 << 20


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of every gram: of its first 16 bytes' number and its last ones', each made of two words of 8 bytes."""
    if len(raw) < GRAM:
        return np.zeros(0, np.uint64)
    words = np.ndarray(len(raw) - 7, "<u8", np.ascontiguousarray(raw), strides=(1,)).astype(np.uint64)
    h = words[:-8] * np.uint64(_BASE)
    h += words[8:]
    h ^= h >> np.uint64(29)  # so that words which differ in their high bytes alone differ in the low ones, too
    h *= np.uint64(_SECOND)
    h[:-16] += h[16:] >> np.uint64(32) | h[16:] << np.uint64(32)
    return mixed(h[:-16])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if width > n else values


def frequency_table(grams: np.ndarray) -> np.ndarray:
    """Whether a gram counts as frequent, by the low bits of its hash. Others that share them count too, everywhere alike."""
    table = np.zeros(_TABLE, np.uint8)
    table[(grams & np.uint64(_TABLE - 1)).astype(np.int64)] = 1
    return table


def runs(text: bytes, length: int, frequent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the maximal runs of windows with the same minimizer, block by block: its hash, the first window, and how many.
    frequent: a table of the grams that come last."""
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw) - length + 1, _BLOCK):
        hashes = gram_hashes(raw[at : at + _BLOCK + length - 1])
        placed = hashes >> np.uint64(1)
        placed &= np.uint64(_MASK ^ 0xFFFFFF)
        placed |= np.arange(len(hashes), dtype=np.uint64)
        last = frequent[(hashes & np.uint64(_TABLE - 1)).view(np.int64)].astype(np.uint64)
        last <<= np.uint64(63)
        placed |= last
        least = _least(placed, length - GRAM + 1) & np.uint64(0xFFFFFF)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        yield hashes[least[first].astype(np.int64)], first + at, np.diff(np.append(first, len(least)))
