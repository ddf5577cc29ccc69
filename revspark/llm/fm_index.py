"""FM-index over a sequence of integer symbols, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the smallest and occur once."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, from the highest bit of the symbols to the lowest.

    At each level symbols with bit 0 go left of those with bit 1, order kept; `ones` counts the 1s before a place.
    """

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.levels = []
        for bit in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            ones = ((sequence >> bit) & 1).astype(bool)
            before = np.zeros(len(sequence) + 1, dtype=np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(sequence) - int(before[-1])
            self.levels.append((bit, before, zeros))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, at = np.zeros_like(places), places
        for bit, before, zeros in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            low = np.where(one, zeros + before[low], low - before[low])
            at = np.where(one, zeros + before[at], at - before[at])
        return at - low

    def symbol_and_rank(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        low, at, symbol = np.zeros_like(places), places, np.zeros_like(places)
        for bit, before, zeros in self.levels:
            one = before[at + 1] > before[at]
            symbol = symbol | (one.astype(symbol.dtype) << bit)
            low = np.where(one, zeros + before[low], low - before[low])
            at = np.where(one, zeros + before[at], at - before[at])
        return symbol, at - low


class FMIndex:
    """Index of `text` (symbols from 1 up): backward search and location by sampled suffix positions."""

    def __init__(self, text: np.ndarray, n_symbols: int, step: int = 16):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], n_symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])  # symbols smaller than c
        sampled = order % step == 0
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of patterns, one a row and all of one length."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, column]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[high[live] > low[live]]
        empty = np.ones(len(patterns), dtype=bool)
        empty[live] = False
        high[empty] = low[empty] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by stepping back to the next sampled one."""
        place, steps, found = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = place[live]
            hit = self.sampled[at + 1] > self.sampled[at]
            found[live[hit]] = self.positions[self.sampled[at[hit]]] + steps[live[hit]]
            live = live[~hit]
            symbol, rank = self.tree.symbol_and_rank(place[live])
            place[live] = self.before[symbol] + rank
            steps[live] += 1
        return found
