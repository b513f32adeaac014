"""BK-trees over sketches under Hamming distance, many at once; children hang at their distance to the parent.

A ``Forest`` holds one tree for each group of words.  Trees grow level by level for all groups
together in numpy: what has arrived below a node is measured against the first of it, which
becomes the child, and goes on below it at its distance.  That is the tree that inserting the
words one after the other gives.  Equal words of a group are one node.  A search carries all
its (word, node) pairs down together and follows only the edges that can lie inside the radius.
"""

from __future__ import annotations

import numpy as np

#: above any distance: edges of a node are numbers below it
_EDGE = 1024
#: (word, node) pairs that are carried at once, about
_FRONT = 2_000_000


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where rows of equal columns, which lie together, begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges [lo, hi), and which range each is of."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


class Forest:
    """Trees of ``words`` (rows of uint64) by ``group``; groups lie together."""

    def __init__(self, group: np.ndarray, words: np.ndarray) -> None:
        n = len(group)
        tree = np.cumsum(_first(group)) - 1
        order = np.lexsort((*words.T, tree))
        new = _first(tree[order], *words[order].T)
        #: items by node, the earliest first; nodes are numbered by their earliest item
        start = np.flatnonzero(new)
        earliest = np.minimum.reduceat(order, start) if n else np.empty(0, np.int64)
        rank = np.argsort(earliest, kind="stable")
        number = np.empty(len(rank), np.int64)
        number[rank] = np.arange(len(rank))
        self.node_of = np.empty(n, np.int64)
        self.node_of[order] = number[np.cumsum(new) - 1]
        self.items = np.argsort(self.node_of, kind="stable")
        self.starts = np.searchsorted(self.node_of[self.items], np.arange(len(rank) + 1))
        head = self.items[self.starts[:-1]]
        self.words, self.tree = words[head], tree[head]
        self._grow()

    def _grow(self) -> None:
        n = len(self.words)
        top = _first(self.tree)
        self.roots = np.flatnonzero(top)
        below, at = np.flatnonzero(~top), np.repeat(self.roots, np.diff(np.append(self.roots, n)))[~top]
        keys, child = [], []
        while len(below):
            d = distance(self.words[below], self.words[at])
            order = np.lexsort((below, d, at))
            below, at, d = below[order], at[order], d[order]
            new = _first(at, d)
            keys.append(at[new] * _EDGE + d[new])
            child.append(below[new])
            parent = np.repeat(below[new], np.diff(np.append(np.flatnonzero(new), len(below))))
            below, at = below[~new], parent[~new]
        keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        child = np.concatenate(child) if child else np.empty(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], child[order]

    def _walk(self, words: np.ndarray, query: np.ndarray, node: np.ndarray, radius: int, earlier: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(query, node) within the radius, from the given (query, node) pairs down, and how many nodes were visited; ``earlier``: queries are nodes, and only nodes before them count."""
        left, right, visits = [], [], 0
        while len(query):
            visits += len(query)
            d = distance(words[query], self.words[node])
            near = d <= radius
            left.append(query[near])
            right.append(node[near])
            lo = np.searchsorted(self.keys, node * _EDGE + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * _EDGE + np.minimum(d + radius, _EDGE - 1), "right")
            at, which = ranges(lo, hi)
            query, node = query[which], self.child[at]
            if earlier:  # a node is the first of all below it
                keep = node < query
                query, node = query[keep], node[keep]
        none = np.empty(0, np.int64)
        return np.concatenate(left) if left else none, np.concatenate(right) if right else none, visits

    def _slices(self, sizes: np.ndarray):
        done = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + _FRONT, "right")))
            yield at, to
            at = to

    def pairs(self, radius: int):
        """(earlier item, later item) arrays of the same tree within the radius, in parts, each with its number of visits."""
        size = np.diff(np.append(self.roots, len(self.words)))
        root = self.roots[np.searchsorted(self.roots, np.arange(len(self.words)), "right") - 1]
        for a, b in self._slices(np.repeat(size, size)):
            q = np.arange(a, b)
            q = q[root[q] != q]
            left, right, visits = self._walk(self.words, q, root[q], radius, True)
            yield (*self._items(right, left), visits)
        several = np.flatnonzero(np.diff(self.starts) > 1)  # equal words
        if len(several):
            place = np.concatenate([np.arange(self.starts[k], self.starts[k + 1]) for k in several])
            end = np.repeat(self.starts[several + 1], np.diff(self.starts)[several])
            for a, b in self._slices(end - place):
                other, which = ranges(place[a:b] + 1, end[a:b])
                yield self.items[place[a:b][which]], self.items[other], len(which)

    def _items(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of pairs of nodes, each of the one's with each of the other's."""
        x, which = ranges(self.starts[one], self.starts[one + 1])
        two = two[which]
        y, which = ranges(self.starts[two], self.starts[two + 1])
        return self.items[x[which]], self.items[y]

    def within(self, words: np.ndarray, radius: int):
        """(item, index of a word) arrays of a forest of one tree, in parts, each with its number of visits."""
        if not len(self.words):
            return
        for a, b in self._slices(np.full(len(words), len(self.words))):
            q, node, visits = self._walk(words, np.arange(a, b), np.zeros(b - a, np.int64), radius, False)
            x, which = ranges(self.starts[node], self.starts[node + 1])
            yield self.items[x], q[which], visits
