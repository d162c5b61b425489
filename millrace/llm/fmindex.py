"""An FM-index over integer sequences: wavelet-matrix ranks, backward search, sampled locate."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling with vectorised sorts."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= 2 * n:
            return order


class WaveletMatrix:
    """Ranks of any symbol in any prefix, in as many steps as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        row = symbols
        for k in range(bits - 1, -1, -1):
            bit = ((row >> k) & 1).astype(np.int32)
            ones = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])
            self.levels.append((k, ones, len(row) - int(ones[-1])))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        begin = np.zeros_like(end)
        for k, ones, zeros in self.levels:
            one = ((symbol >> k) & 1).astype(bool)
            a, b = ones[begin], ones[end]
            begin, end = np.where(one, zeros + a, begin - a), np.where(one, zeros + b, end - b)
        return end - begin


class FMIndex:
    """Over ``symbols`` >= 1; 0 is kept for the end mark."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        text = np.concatenate([symbols.astype(np.int64), [0]])
        order = suffix_array(text)
        self.bwt = text[order - 1]
        top = int(text.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.wavelet = WaveletMatrix(self.bwt, max(1, top.bit_length()))
        self.marked = order % sample == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.positions = order[self.marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases of one length, a row each, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for c in phrases.T[::-1]:
            known = c < len(self.before) - 1
            c = np.where(known, c, 0)
            low, high = self.before[c] + self.wavelet.rank(c, low), self.before[c] + self.wavelet.rank(c, high)
            high = np.where(known, high, low)
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step backward until a sampled one."""
        out, steps, live, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(live):
            hit = self.marked[at[live]]
            done = live[hit]
            out[done] = self.positions[self.mark_rank[at[done]]] + steps
            live = live[~hit]
            c = self.bwt[at[live]]
            at[live] = self.before[c] + self.wavelet.rank(c, at[live])
            steps += 1
        return out
