"""Signature trees: sets summarised by bitmaps, and pairs of sets found by dual traversal.

A leaf holds a few sets of similar size; a node holds the OR of its bitmaps, the range of its sets' sizes
and the most elements any of its sets hides behind shared bits. Two nodes are pursued only if their sizes
are near enough and the bits they have in common leave room for the overlap that a link needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Sets of a leaf.
LEAF = 16


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of bits / 64 words for each set of hashes."""
    out = np.zeros((len(sets), bits), bool)
    for row, members in zip(out, sets):
        row[((members >> np.uint64(17)) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def needed(total: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of two sets of `total` elements together whose intersection is `percent` of their union."""
    return -(-percent * total // (100 + percent))


class UnionFind:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


class SignatureTree:
    def __init__(self, sizes: np.ndarray, signatures: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.signatures = sizes[self.order].astype(np.int64), signatures[self.order]
        hidden = self.sizes - np.bitwise_count(self.signatures).sum(axis=1, dtype=np.int64)
        cuts = list(range(0, len(sizes), LEAF))
        level = [(a, min(a + LEAF, len(sizes)), np.bitwise_or.reduce(self.signatures[a : a + LEAF]), int(hidden[a : a + LEAF].max()), ()) for a in cuts]
        while len(level) > 1:
            pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
            level = [p[0] if len(p) == 1 else (p[0][0], p[1][1], p[0][2] | p[1][2], max(p[0][3], p[1][3]), tuple(p)) for p in pairs]
        self.root = level[0] if level else None

    def _possible(self, x: tuple, y: tuple) -> bool:
        (a, b), (c, d) = (self.sizes[x[0]], self.sizes[x[1] - 1]), (self.sizes[y[0]], self.sizes[y[1] - 1])
        if 100 * b < self.percent * c or 100 * d < self.percent * a:
            return False
        shared = int(np.bitwise_count(x[2] & y[2]).sum()) + min(x[3], y[3])
        return shared >= needed(a + c, self.percent)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions, in the order given, of the pairs that may be linked, leaf pair by leaf pair."""
        todo = [(self.root, self.root)] if self.root else []
        while todo:
            x, y = todo.pop()
            if not self._possible(x, y):
                continue
            if x is y and x[4]:
                todo += [(x[4][0], x[4][1]), (x[4][1], x[4][1]), (x[4][0], x[4][0])]
            elif x[4] and (not y[4] or x[1] - x[0] >= y[1] - y[0]):
                todo += [(child, y) for child in x[4]]
            elif y[4]:
                todo += [(x, child) for child in y[4]]
            else:
                yield self._leaf_pairs(x, y)

    def _leaf_pairs(self, x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.sizes[x[0] : x[1], None], self.sizes[None, y[0] : y[1]]
        apart = np.bitwise_count(self.signatures[x[0] : x[1], None] ^ self.signatures[None, y[0] : y[1]]).sum(axis=2, dtype=np.int64)
        fits = ((a + b - apart) // 2 >= needed(a + b, self.percent)) & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b))
        i, j = np.nonzero(np.triu(fits, 1) if x is y else fits)
        return self.order[i + x[0]], self.order[j + y[0]]


def link(sizes: np.ndarray, signatures: np.ndarray, groups: np.ndarray, percent: int, holds: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that join the given groups further, as a spanning forest: a pair is tested only while its ends are
    still apart. holds: the exact test; without it what the bitmaps allow is joined."""
    first: dict[int, int] = {}
    sets = UnionFind(len(sizes))
    for i, g in enumerate(groups.tolist()):
        sets.join(i, first.setdefault(g, i))
    apart, found = len(first), []
    for left, right in SignatureTree(sizes, signatures, percent).candidates():
        for i, j in zip(left.tolist(), right.tolist()):
            if apart == 1:
                return found
            if sets.find(i) != sets.find(j) and (holds is None or holds(i, j)):
                sets.join(i, j)
                found.append((i, j))
                apart -= 1
    return found
