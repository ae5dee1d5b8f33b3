"""Suffix trees by Ukkonen's construction, with constant-time longest common extensions."""

from __future__ import annotations

import numpy as np

#: Places of the Euler tour that are looked at one by one; between such blocks a table of powers of two answers.
_BLOCK = 16
#: Queries answered at once.
_QUERIES = 1 << 18


class SuffixTree:
    """Of `symbols`, numbers from 1, with an end symbol 0 put behind them. Leaf j stands for the suffix that begins at j."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self.width = max(symbols, default=0) + 1
        self._build([*symbols, 0])

    def _build(self, s: list[int]) -> None:
        """Ukkonen: symbol by symbol, each adding the leaves of the suffixes that have ended in an inner place of the tree.
        origin: a suffix that runs through the node, so that a node is (end - origin) symbols deep; leaves are made in the
        order of their suffixes."""
        n, width = len(s), self.width
        go: dict[int, int] = {}  # node * width + first symbol of an edge -> the node below
        starts, ends, links, origin, leaves = [0], [0], [0], [0], []
        active = edge = length = rest = 0
        for i, c in enumerate(s):
            rest += 1
            last = 0
            while rest:
                if not length:
                    edge = i
                key = active * width + s[edge]
                child = go.get(key)
                if child is None:
                    go[key] = node = len(starts)
                    starts.append(i)
                    above = active
                else:
                    start = starts[child]
                    size = ends[child] - start
                    if length >= size:
                        active, edge, length = child, edge + size, length - size
                        continue
                    if s[start + length] == c:
                        length += 1
                        if last:
                            links[last] = active
                        break
                    go[key] = above = len(starts)  # the edge is split by a new node
                    starts.append(start)
                    ends.append(start + length)
                    links.append(0)
                    origin.append(origin[child])
                    starts[child] = start = start + length
                    go[above * width + s[start]] = child
                    node = len(starts)
                    go[above * width + c] = node
                    starts.append(i)
                if last:
                    links[last] = above
                last = above if child is not None else 0
                ends.append(n)
                links.append(0)
                origin.append(len(leaves))
                leaves.append(node)
                rest -= 1
                if active:
                    active = links[active]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.leaves = np.array(leaves)
        self.depth = np.array(ends) - np.array(origin)
        keys, self._below = np.fromiter(go, np.int64, len(go)), np.fromiter(go.values(), np.int64, len(go))
        self._above, self._first = keys // width, keys % width

    def _children(self, descending: bool) -> list[list[int]]:
        """The children of every node, the end symbol's first, then by symbol."""
        rank = (self.width - self._first) % self.width if descending else self._first
        order = np.lexsort((rank, self._above))
        counts = np.bincount(self._above, minlength=len(self.depth))
        below, cuts = self._below[order].tolist(), np.concatenate([[0], np.cumsum(counts)]).tolist()
        return [below[a:b] for a, b in zip(cuts, cuts[1:])]

    def suffix_ranks(self, descending: bool = False) -> np.ndarray:
        """Rank of every suffix in the order of symbols, or in that of symbols turned round; a prefix comes first in both."""
        children, stack, seen = self._children(descending), [0], []
        while stack:
            node = stack.pop()
            if below := children[node]:
                stack += below[::-1]
            else:
                seen.append(node)
        ranks = np.zeros(len(self.depth), np.int64)
        ranks[seen] = np.arange(len(seen))
        return ranks[self.leaves]

    def prepare(self) -> None:
        """Lay out the Euler tour and the tables that answer `common`."""
        children, stack, tour = self._children(False), [0], []
        while stack:
            node = stack.pop()
            if node < 0:
                tour.append(~node)
                continue
            tour.append(node)
            back = ~node
            for child in reversed(children[node]):
                stack.append(back)
                stack.append(child)
        tour = np.array(tour)
        place = np.zeros(len(self.depth), np.int64)
        place[tour] = np.arange(len(tour))  # the last place; a leaf has one only
        self._place = place[self.leaves]
        padded = np.full(-(-len(tour) // _BLOCK) * _BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(tour)] = self.depth[tour]
        blocks = padded.reshape(-1, _BLOCK)
        self._tour = np.append(padded, np.full(_BLOCK, np.iinfo(np.int32).max, np.int32))
        self._from_left = np.minimum.accumulate(blocks, axis=1).ravel()
        self._from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self._powers = [blocks.min(axis=1)]
        while (size := 1 << len(self._powers)) <= len(blocks):
            below = self._powers[-1]
            self._powers.append(np.minimum(below[: len(below) - size // 2], below[size // 2 :]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b, which differ, pair by pair: the depth of the leaves' lowest
        common ancestor, the least on the tour between them."""
        return np.concatenate([self._common(a[k : k + _QUERIES], b[k : k + _QUERIES]) for k in range(0, len(a), _QUERIES)] or [np.zeros(0, np.int64)])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left, right = np.minimum(self._place[a], self._place[b]), np.maximum(self._place[a], self._place[b])
        first, last = left // _BLOCK, right // _BLOCK
        found = np.minimum(self._from_right[left], self._from_left[right]).astype(np.int64)
        near = np.flatnonzero(first == last)
        if len(near):
            steps = np.arange(_BLOCK)
            window = self._tour[left[near][:, None] + steps]
            found[near] = np.where(steps <= (right - left)[near][:, None], window, np.iinfo(np.int32).max).min(axis=1)
        far = np.flatnonzero(last - first > 1)
        if len(far):
            size = (last - first - 1)[far]
            level = np.frexp(size.astype(float))[1] - 1
            for k in np.unique(level).tolist():
                at, table = far[level == k], self._powers[k]
                found[at] = np.minimum(found[at], np.minimum(table[first[at] + 1], table[last[at] - (1 << k)]))
        return found


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For every place but the last, the next one of smaller rank; the last rank must be the least."""
    values = ranks.tolist()
    found, stack = [0] * (len(values) - 1), [len(values) - 1]
    for i in range(len(values) - 2, -1, -1):
        own = values[i]
        while values[stack[-1]] > own:
            stack.pop()
        found[i] = stack[-1]
        stack.append(i)
    return np.array(found, np.int64)
