"""Signature trees over sets: which sets of a bounded group are linked by Jaccard similarity.

A set's signature is a bitmap with a bit for each token's hash. A tree node holds the OR of its members' bitmaps and the
range of their sizes. Two trees are walked together, and a pair of nodes is left as soon as no pair of their members can
overlap enough: at most `popcount(OR1 & OR2)` tokens plus those that share a bit with another token of their set can be
common. Pairs of sets that reach the leaves are compared exactly. Pairs already joined through other links are skipped:
the result is the connected components, which need no more than a link that spans them.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
CHUNK = 4096


class UnionFind:
    def __init__(self, labels: np.ndarray):
        self.root = labels.copy()

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)

    def all(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root
            self.root = up


def least_overlap(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of two sets of these sizes in total whose Jaccard similarity is `percent` or more."""
    return -(-percent * sizes // (100 + percent))


class SignatureTree:
    """Levels from the members up: bitmaps, least and largest size, most tokens that share a bit, spans of children."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        width = 256
        while width < 2 * sizes.max() and width < 8192:
            width *= 2
        bits = np.zeros((len(sets), width), dtype=bool)
        for k, s in enumerate(sets):
            bits[k, s & np.uint64(width - 1)] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        self.sets, self.sizes = sets, sizes
        shared = sizes - np.bitwise_count(packed).sum(axis=1).astype(np.int64)
        self.levels = [(packed, sizes, sizes, shared)]
        while len(self.levels[-1][0]) > 1:
            packed, low, high, shared = self.levels[-1]
            cut = np.arange(0, len(packed), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(packed, cut), np.minimum.reduceat(low, cut),
                                np.maximum.reduceat(high, cut), np.maximum.reduceat(shared, cut)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether some member of node a can be linked to some member of node b."""
        packed, low, high, shared = self.levels[level]
        fits = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        common = np.zeros(len(a), dtype=np.int64)
        common[fits] = np.bitwise_count(packed[a[fits]] & packed[b[fits]]).sum(axis=1)
        most = np.minimum(common + np.minimum(shared[a], shared[b]), np.minimum(high[a], high[b]))
        return fits & (most >= least_overlap(low[a] + low[b], percent))


def _children(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of pairs of nodes a <= b, each pair once; n nodes below."""
    k = np.arange(FANOUT)
    x = (a[:, None, None] * FANOUT + k[:, None]) + np.zeros((1, 1, FANOUT), dtype=np.int64)
    y = (b[:, None, None] * FANOUT + k[None, :]) + np.zeros((1, FANOUT, 1), dtype=np.int64)
    x, y = x.reshape(-1), y.reshape(-1)
    good = (x < n) & (y < n) & ((x <= y))
    return x[good], y[good]


def linked(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Label of each set: the smallest position that links reach. Sets are sorted arrays of distinct unsigned 64-bit
    hashes, none empty. With `labels` (positions) sets of one label count as joined already."""
    order = np.array(sorted(range(len(sets)), key=lambda k: len(sets[k])), dtype=np.int64)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    tree = SignatureTree([sets[k] for k in order])
    joined = UnionFind(np.arange(len(sets)))
    for k, label in enumerate(labels if labels is not None else ()):
        joined.union(int(place[k]), int(place[label]))
    stack = [(len(tree.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > CHUNK:
            for k in range(len(a) // CHUNK * CHUNK, -1, -CHUNK):
                stack.append((level, a[k:k + CHUNK], b[k:k + CHUNK]))
            continue
        if level == 0:
            root = joined.all()
            open_ = (a < b) & (root[a] != root[b])
            a, b = a[open_], b[open_]
            may = tree.possible(0, a, b, percent)
            for x, y in zip(a[may].tolist(), b[may].tolist(), strict=True):
                if joined.find(x) != joined.find(y):
                    total = len(tree.sets[x]) + len(tree.sets[y])
                    if overlap(tree.sets[x], tree.sets[y]) >= least_overlap(np.int64(total), percent):
                        joined.union(x, y)
            continue
        may = tree.possible(level, a, b, percent)
        x, y = _children(a[may], b[may], len(tree.levels[level - 1][0]))
        if len(x):
            stack.append((level - 1, x, y))
    root = joined.all()
    # labels in terms of the given positions
    least = np.full(len(sets), len(sets), dtype=np.int64)
    np.minimum.at(least, root, order)
    return least[root[place]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())
