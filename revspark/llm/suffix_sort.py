"""Hash-compared suffix sort of many short contexts, and the windows that they share.

A context is a stretch of text around an anchor, a byte gram that also occurs elsewhere. Contexts of one anchor gram form
a group. The bytes right of the anchors and, reversed, left of them are sorted within each group by a mergesort whose
comparisons find the longest common extension of two strings by binary search over prefix hashes, then compare the byte
behind it. The common extensions of neighbours in the order are verified against the bytes; if a hash collided, the sort is
done again with another multiplier. Two contexts share the window that starts s bytes left of the anchor if they agree on
s bytes to the left and on the rest to the right, so one cut through each order gives the classes of equal windows.
"""

from __future__ import annotations

import numpy as np

_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)


class Extensions:
    """Equally long rows of bytes with their prefix hashes; rows shorter than that are padded behind their size."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, seed: int):
        self.rows, self.sizes = rows, sizes
        width = rows.shape[1]
        self.hashes = np.zeros((len(rows), width + 1), dtype=np.uint64)
        step = np.uint64(seed | 1)
        with np.errstate(over="ignore"):
            for k in range(width):
                self.hashes[:, k + 1] = self.hashes[:, k] * step + rows[:, k].astype(np.uint64) + np.uint64(1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extension of pairs of rows: binary search for the longest prefix of equal hashes."""
        low = np.zeros(len(x), dtype=np.int64)
        high = np.minimum(self.sizes[x], self.sizes[y])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hashes[x, mid] == self.hashes[y, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether row x sorts before row y; equal rows: `ties`."""
        at = self.common(x, y)
        end_x, end_y = at == self.sizes[x], at == self.sizes[y]
        last = self.rows.shape[1] - 1
        a, b = self.rows[x, np.minimum(at, last)], self.rows[y, np.minimum(at, last)]
        return np.where(end_x & end_y, ties, np.where(end_x, True, np.where(end_y, False, a < b)))

    def order(self, group: np.ndarray) -> np.ndarray:
        """Mergesort of the rows within their groups (`group` is ascending): runs of doubling width, merged by ranks."""
        order = np.arange(len(group))
        start = np.searchsorted(group, group)
        end = np.searchsorted(group, group, side="right")
        place = order - start
        width = 1
        while width < (end - start).max(initial=0):
            run = place // width
            left = run % 2 == 0
            other = start + np.where(left, run + 1, run - 1) * width  # first place of the run to merge with
            stop = np.minimum(other + width, end)
            live = np.flatnonzero(other < end)
            low, high = other[live].copy(), stop[live].copy()
            rows, is_left = order[live], left[live]
            # how many rows of the other run come first: a left row goes before its equals, a right one behind them
            while (low < high).any():
                open_ = low < high
                mid = (low + high) >> 1
                probe = order[np.minimum(mid, len(order) - 1)]
                first = np.where(is_left, self.before(probe, rows, False), self.before(probe, rows, True))
                low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
            ahead = low - other[live]
            base = start[live] + run[live] // 2 * 2 * width
            fresh = order.copy()
            fresh[base + place[live] % width + ahead] = rows
            order = fresh
            width *= 2
        return order

    def verified(self, order: np.ndarray, group: np.ndarray) -> np.ndarray | None:
        """Common extension of each row of the order with the one before it (-1 for a group's first); None if it is not
        what the bytes say or the order is wrong."""
        out = np.full(len(order), -1, dtype=np.int64)
        near = np.flatnonzero(group[1:] == group[:-1]) + 1
        x, y = order[near - 1], order[near]
        found = self.common(x, y)
        size = np.minimum(self.sizes[x], self.sizes[y])
        for k in range(0, len(near), 20_000):
            part = slice(k, k + 20_000)
            differ = self.rows[x[part]] != self.rows[y[part]]
            real = np.where(differ.any(axis=1), differ.argmax(axis=1), self.rows.shape[1])
            if (np.minimum(real, size[part]) != found[part]).any():
                return None
        if not self.before(x, y, True).all():
            return None
        out[near] = found
        return out


def _sorted(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for seed in _SEEDS:
        e = Extensions(rows, sizes, seed)
        order = e.order(group)
        common = e.verified(order, group)
        if common is not None:
            return order, common
    raise ArithmeticError("prefix hashes collide under every multiplier")


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), width)


def shared_windows(contexts: list[bytes], left: np.ndarray, n_windows: np.ndarray, twice: np.ndarray, group: np.ndarray,
                   width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start (in its context, -1 for none) of each context's windows that occur elsewhere.

    Contexts are distinct within their group (ascending numbers); each holds `n_windows` windows of `width` bytes and its
    anchor `left` bytes from its start. twice: the context itself occurs more than once.
    """
    n = len(contexts)
    first = np.where(twice, 0, -1)
    last = np.where(twice, n_windows - 1, -1)
    size = np.bincount(group)[group] if n else np.zeros(0, dtype=np.int64)
    mixed = np.flatnonzero(size > 1)
    if not len(mixed):
        return first, last
    g = group[mixed]
    hi = left[mixed]
    lo = hi - n_windows[mixed] + 1
    right_parts = [contexts[k][left[k]:] for k in mixed]
    left_parts = [contexts[k][:left[k]][::-1] for k in mixed]
    r_order, r_common = _sorted(_matrix(right_parts, width), np.array([len(p) for p in right_parts]), g)
    deepest = max(1, int(hi.max()))
    l_order, l_common = _sorted(_matrix(left_parts, deepest), hi, g)
    least = np.full(len(mixed), -1)
    most = np.full(len(mixed), -1)
    r_class, l_class = np.empty(len(mixed), dtype=np.int64), np.empty(len(mixed), dtype=np.int64)
    for s in range(deepest + 1):
        valid = (lo <= s) & (s <= hi)
        if valid.sum() < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < width - s)
        l_class[l_order] = np.cumsum(l_common < s)
        at = np.flatnonzero(valid)
        key = r_class[at] * (len(mixed) + 1) + l_class[at]
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        hit = np.zeros(len(at), dtype=bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        hit = at[hit]
        least[hit] = np.where(least[hit] < 0, s, least[hit])
        most[hit] = s
    found = most >= 0
    begin, end = hi - most, hi - least  # starts in the context run against s
    rows = mixed[found & ~twice[mixed]]
    pick = found & ~twice[mixed]
    first[rows], last[rows] = begin[pick], end[pick]
    return first, last
