"""Signature trees over token sets, and their dual traversal.

A leaf holds a few sets of similar size; every node keeps the OR of its sets'
token bitmaps, its range of set sizes and the largest number of tokens that
share a bit in one set.  For sets a and b the overlap is at most
``popcount(bits(a) & bits(b)) + min(slack(a), slack(b))``, where slack is the
number of tokens less the number of bits: among common tokens no more can be
hidden by shared bits than among all tokens of either set.  ORs and maxima only
raise the bound, so it also holds for nodes, and a pair of nodes whose bound is
below the least overlap that their sizes ask for holds no link.

For connectivity a pair of nodes that already lie in one class is passed over,
and each link that joins two classes is given once.  ``LinkCounts`` passes over
nothing and counts every link.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
LEAF = 8
FANOUT = 4
#: Two sets link when 100 * intersection >= 75 * union.
PER_CENT = 75


def links(common: int, a: int, b: int, per_cent: int = PER_CENT) -> bool:
    return 100 * common >= per_cent * (a + b - common)


def least_overlap(sizes, per_cent: int = PER_CENT):
    """The least intersection of sets with these sizes in sum that link."""
    return -(-per_cent * sizes // (100 + per_cent))


class _Node:
    __slots__ = ("bits", "children", "first", "high", "last", "low", "one", "slack")


class SignatureTree:
    """Sets ``tokens[i]`` (sorted distinct integers, a superset of what can be shared) of true sizes ``sizes[i]``."""

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray, classes: np.ndarray, per_cent: int = PER_CENT):
        order = np.lexsort((sizes, classes))
        self.order, self.per_cent = order, per_cent
        self.tokens = [tokens[i] for i in order]
        self.sizes = np.asarray(sizes)[order].astype(np.int64)
        longest = max((len(t) for t in self.tokens), default=1)
        self.n_bits = int(min(1 << 15, max(1 << 10, 1 << int(np.ceil(np.log2(4 * longest + 1))))))
        words = self.n_bits // 64
        self.bits = np.zeros((len(order), words), dtype=U64)
        self.slack = np.zeros(len(order), dtype=np.int64)
        for i, t in enumerate(self.tokens):
            at = np.unique((t.astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(40)) % U64(self.n_bits))
            np.bitwise_or.at(self.bits[i], (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
            self.slack[i] = len(t) - len(at)
        self.parent = list(range(len(order)))
        known: dict[int, int] = {}
        for i, c in enumerate(np.asarray(classes)[order].tolist()):
            self.parent[i] = known.setdefault(c, i)
        self.found: list[tuple[int, int]] = []
        self.compared = self.verified = 0
        level = [self._leaf(i, min(i + LEAF, len(order))) for i in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [self._inner(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        self.root = level[0] if level else None

    def _leaf(self, first: int, last: int) -> _Node:
        n = _Node()
        n.first, n.last, n.children, n.one = first, last, [], False
        n.bits = np.bitwise_or.reduce(self.bits[first:last])
        n.low, n.high = int(self.sizes[first:last].min()), int(self.sizes[first:last].max())
        n.slack = int(self.slack[first:last].max())
        return n

    def _inner(self, children: list[_Node]) -> _Node:
        n = _Node()
        n.first, n.last, n.children, n.one = children[0].first, children[-1].last, children, False
        n.bits = np.bitwise_or.reduce([c.bits for c in children])
        n.low, n.high = min(c.low for c in children), max(c.high for c in children)
        n.slack = max(c.slack for c in children)
        return n

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _in_one_class(self, n: _Node) -> bool:
        if not n.one:
            if n.children:
                n.one = all(map(self._in_one_class, n.children)) and len({self.find(c.first) for c in n.children}) == 1
            else:
                n.one = len({self.find(i) for i in range(n.first, n.last)}) == 1
        return n.one

    def run(self) -> list[tuple[int, int]]:
        """Links (positions in the input) that join classes; afterwards linked sets are in one class."""
        if self.root:
            self._within(self.root)
        return [(int(self.order[a]), int(self.order[b])) for a, b in self.found]

    def _within(self, n: _Node) -> None:
        if self._in_one_class(n):
            return
        if not n.children:
            self._leaves(n, n)
            return
        for c in n.children:
            self._within(c)
        for i, c in enumerate(n.children):
            for d in n.children[i + 1 :]:
                self._between(c, d)

    def _between(self, a: _Node, b: _Node) -> None:
        if 100 * a.high < self.per_cent * b.low or 100 * b.high < self.per_cent * a.low:
            return
        self.compared += 1
        most = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.slack, b.slack)
        if most < least_overlap(a.low + b.low, self.per_cent):
            return
        if self._in_one_class(a) and self._in_one_class(b) and self.find(a.first) == self.find(b.first):
            return
        if not a.children and not b.children:
            self._leaves(a, b)
        elif a.children and (not b.children or a.last - a.first >= b.last - b.first):
            for c in a.children:
                self._between(c, b)
        else:
            for c in b.children:
                self._between(a, c)

    def _leaves(self, a: _Node, b: _Node) -> None:
        x, y = slice(a.first, a.last), slice(b.first, b.last)
        most = np.bitwise_count(self.bits[x][:, None, :] & self.bits[y][None, :, :]).sum(axis=2, dtype=np.int64)
        most += np.minimum(self.slack[x][:, None], self.slack[y][None, :])
        fit = most >= least_overlap(self.sizes[x][:, None] + self.sizes[y][None, :], self.per_cent)
        for i, j in zip(*np.nonzero(fit), strict=True):
            i, j = int(i) + a.first, int(j) + b.first
            if (a is b and i >= j) or self.find(i) == self.find(j):
                continue
            self.verified += 1
            s, t = self.tokens[i], self.tokens[j]
            at = np.searchsorted(t, s)
            common = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0
            if links(common, int(self.sizes[i]), int(self.sizes[j]), self.per_cent):
                self.parent[self.find(i)] = self.find(j)
                self.found.append((i, j))


class LinkCounts(SignatureTree):
    """All links, counted for every set with the weight of the other set.

    Where ``side`` has two values only pairs across them count.  With ``only``,
    a token, just those pairs count whose smallest common token it is.
    """

    WAITING = 1 << 20  # pairs gathered before they are verified

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray, near: np.ndarray, weights: np.ndarray, side: np.ndarray, per_cent: int = PER_CENT, only: int | None = None):
        _, near = np.unique(near, return_inverse=True)
        super().__init__(tokens, sizes, np.asarray(side).astype(np.int64) * len(near) + near, per_cent)
        self.side, self.weights, self.only = np.asarray(side)[self.order], np.asarray(weights)[self.order], only
        self.cross = bool((self.side[:1] != self.side[-1:]).any())
        self.at = np.append(0, np.cumsum([len(t) for t in self.tokens])).astype(np.int64)
        self.known, ids = np.unique(np.concatenate(self.tokens) if self.tokens else np.empty(0, U64), return_inverse=True)
        self.ids = ids.astype(np.int32)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0
        self.counts = np.zeros(len(self.order), dtype=np.int64)

    def find(self, i: int) -> int:
        return int(self.side[i])

    def _in_one_class(self, n: _Node) -> bool:
        return self.cross and self.side[n.first] == self.side[n.last - 1]

    def run(self) -> np.ndarray:
        """The sum of the weights of the linked sets, for every set in the order of the input."""
        if self.root:
            self._within(self.root)
            self._verify()
        out = np.empty_like(self.counts)
        out[self.order] = self.counts
        return out

    def _leaves(self, a: _Node, b: _Node) -> None:
        x, y = slice(a.first, a.last), slice(b.first, b.last)
        most = np.bitwise_count(self.bits[x][:, None, :] & self.bits[y][None, :, :]).sum(axis=2, dtype=np.int64)
        most += np.minimum(self.slack[x][:, None], self.slack[y][None, :])
        fit = most >= least_overlap(self.sizes[x][:, None] + self.sizes[y][None, :], self.per_cent)
        if a is b:
            fit = np.triu(fit, 1)
        if self.cross:
            fit &= self.side[x][:, None] != self.side[y][None, :]
        i, j = np.nonzero(fit)
        if len(i):
            self.pairs.append((i + a.first, j + b.first))
            self.n_waiting += len(i)
            if self.n_waiting >= self.WAITING:
                self._verify()

    def _verify(self) -> None:
        """Exact counts of common tokens of the pairs that wait: one set at a time against all its partners."""
        if not self.pairs:
            return
        i, j = (np.concatenate(c) for c in zip(*self.pairs, strict=True))
        self.pairs, self.n_waiting = [], 0
        self.verified += len(i)
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        cuts = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i))
        mark = np.zeros(len(self.known), dtype=bool)
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            me, others = int(i[first]), j[first:last]
            own = self.ids[self.at[me] : self.at[me + 1]]
            mark[own] = True
            low, high = int(others[0]), int(others[-1]) + 1
            if high - low <= 2 * len(others):  # a run of sets
                theirs, starts, take = self.ids[self.at[low] : self.at[high]], self.at[low:high] - self.at[low], others - low
            else:
                lens = self.at[others + 1] - self.at[others]
                starts, take = np.cumsum(lens) - lens, slice(None)
                theirs = self.ids[np.repeat(self.at[others] - starts, lens) + np.arange(int(lens.sum()))]
            hit = mark[theirs]
            common = np.add.reduceat(hit, starts, dtype=np.int64)[take]
            linked = 100 * common >= self.per_cent * (self.sizes[me] + self.sizes[others] - common)
            if self.only is not None:
                least = np.minimum.reduceat(np.where(hit, theirs, len(self.known)), starts)[take]
                linked &= least == np.searchsorted(self.known, U64(self.only))
            mark[own] = False
            others = others[linked]
            self.counts[me] += self.weights[others].sum()
            self.counts[others] += self.weights[me]
