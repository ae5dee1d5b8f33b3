"""Suffix arrays by induced sorting, and permuted longest common prefixes, over numpy arrays.

A suffix falls or rises by whether the next one is smaller. The leftmost of rising ones are sorted by their
substrings, and these by their names, level below level, until all names differ; a level is half as long as the
one above at most. From the order of the leftmost, that of all falling suffixes is induced: such a suffix is its
symbols down to the next leftmost rising one, whose rank is known. From the order of the falling ones, that of
all rising ones is induced in the same way. A bucket scan takes these steps suffix by suffix; here all suffixes of
a kind take a step at once, and only those that are still level take another. Equal symbols in a row are one step, so
there are as many steps as symbols in the longest part that falls or rises throughout and stands twice, at most.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether suffixes are smaller than the next one, and where the next other symbol stands; the last symbol must be the
    smallest and stand once, and is followed by itself."""
    n = len(s)
    ends = np.flatnonzero(s[1:] != s[:-1])  # the last places of equal symbols in a row
    counts = np.diff(ends, prepend=-1)
    rises = s[ends] < s[ends + 1]
    return np.append(np.repeat(rises, counts), True), np.append(np.repeat(ends + 1, counts), n - 1)


def _sorted(places: np.ndarray, codes: np.ndarray, follow: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """places by the codes there, at the places that follow, and so on, and for each whether it differs from the one before.
    A code that stands once ends that; last: later places where equal ones end, too."""
    bits = int(codes.max()).bit_length()
    at, key = places, codes[places]
    if two := 2 * bits < 64:
        at = follow[places]
        key = key << bits | codes[at]
    order = np.argsort(key)
    places, at, key = places[order], at[order], key[order]
    differs = np.append(True, key[1:] != key[:-1])
    level, fresh = np.arange(len(places)), differs
    while True:
        # only those that are level with a neighbour go on
        go = ~(fresh & np.append(fresh[1:], True))
        if last is not None and two:
            go &= ~last[at]
        level, at, fresh, two = level[go], follow[at[go]], fresh[go], True
        if not len(level):
            return places, differs
        group, code = np.cumsum(fresh), codes[at]
        order = np.argsort(group << bits | code) if int(group[-1]).bit_length() + bits < 64 else np.lexsort((code, group))
        at, code = at[order], code[order]
        places[level] = places[level[order]]
        fresh = np.append(True, fresh[1:] | (code[1:] != code[:-1]))
        differs[level] = fresh


def _codes(s: np.ndarray, rises: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Numbers that are ordered by symbol, then falling before rising, then by inner."""
    return (s.astype(np.int64) << 1 | rises) << int(inner.max()).bit_length() | inner


def suffix_array(s: np.ndarray, levels: list[int] | None = None) -> np.ndarray:
    """Suffix array of s, whose last symbol is 0 and stands nowhere else. levels: takes the length of each level below."""
    n = len(s)
    if n <= 2:
        return np.argsort(s, kind="stable")
    rises, follow = _types(s)
    leftmost = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
    row = follow - np.arange(n)  # of equal symbols, the more the smaller where they rise
    row = np.where(rises, row.max() - row, row)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ranked, differs = _sorted(leftmost, _codes(s, rises, row), follow, is_leftmost)
    place = np.empty(n, np.int64)
    place[ranked] = np.cumsum(differs) - 1
    ranks = place[leftmost]
    if not differs.all():
        if levels is not None:
            levels.append(len(ranks))
        names, ranks = ranks, np.empty(len(leftmost), np.int64)
        ranks[suffix_array(names, levels)] = np.arange(len(names))
    inner = row.copy()
    inner[leftmost] = ranks
    falling, _ = _sorted(np.flatnonzero(~rises), _codes(s, rises, inner), follow)
    inner = row
    inner[falling] = np.arange(len(falling))
    rising, _ = _sorted(np.flatnonzero(rises), _codes(s, rises, inner), follow)
    # a symbol's falling suffixes come before its rising ones
    size = int(s.max()) + 1
    fall, rise = np.bincount(s[falling], minlength=size), np.bincount(s[rising], minlength=size)
    sa = np.empty(n, np.int64)
    sa[np.arange(len(falling)) + (np.cumsum(rise) - rise)[s[falling]]] = falling
    sa[np.arange(len(rising)) + np.cumsum(fall)[s[rising]]] = rising
    return sa


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, how many symbols its suffix shares with the one before it in the suffix array.

    Where the symbols before both suffixes agree too, the length is one less than at the place before; only the other
    places are compared, some symbols at a time."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    reducible = np.zeros(n, bool)
    i = np.flatnonzero((before[1:] > 0)) + 1
    reducible[i] = (s[i - 1] == s[before[i] - 1]) & (before[i - 1] == before[i] - 1)
    # as many symbols to a word as fit, the first in the lowest bits; the last symbol, which stands once, ends every comparison
    bits = max(1, int(s.max()).bit_length())
    width = min(63 // bits, n)
    words = np.zeros(n + width - 1, np.int64)
    words[:n] = s
    for k in range(1, width):
        words[: n - k] |= s[k:].astype(np.int64) << bits * k
    found = np.zeros(n, np.int64)
    irreducible = np.flatnonzero(~reducible & (before >= 0))
    todo, step = irreducible, 0
    while len(todo):
        todo = todo[words[todo + step] == words[before[todo] + step]]
        step += width
        found[todo] = step
    unlike = words[irreducible + found[irreducible]] ^ words[before[irreducible] + found[irreducible]]
    found[irreducible] += np.bitwise_count((unlike & -unlike) - 1) // bits
    last = np.maximum.accumulate(np.where(~reducible, np.arange(n), 0))
    return np.where(reducible, found[last] - (np.arange(n) - last), found)
