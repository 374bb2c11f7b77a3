"""FM-index over word symbols: suffix order by prefix doubling, wavelet-tree ranks, sampled positions.

All patterns are searched backwards at once with numpy. Symbol 0 separates runs and is never searched.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Full suffix order of `text`; zeros order by position, so each is a symbol of its own."""
    n = len(text)
    zeros = text == 0
    rank = np.where(zeros, np.cumsum(zeros), text.astype(np.int64) + zeros.sum() + 1)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletTree:
    """Ranks over a sequence of symbols below 2**bits, one bit vector with prefix counts a level (zeros first)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = bits
        for k in reversed(range(bits)):
            one = (symbols >> k) & 1
            ones = np.concatenate([[0], np.cumsum(one)]).astype(np.int32)
            self.levels.append((ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        first = np.zeros_like(at)
        for k, (ones, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            up = ((symbol >> k) & 1).astype(bool)
            a, f = ones[at], ones[first]
            at, first = np.where(up, zeros + a, at - a), np.where(up, zeros + f, first - f)
        return at - first


class FMIndex:
    SAMPLE = 8

    def __init__(self, text: np.ndarray, symbols: int):
        """text ends with 0; symbols: number of distinct symbols, 0 included."""
        self.n = len(text)
        order = suffix_array(text)
        before = text[order - 1]  # position 0 is preceded by the last symbol, a 0
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.bwt = before
        self.tree = WaveletTree(before, max(1, int(symbols - 1).bit_length()))
        kept = (order % self.SAMPLE == 0) | (before == 0)
        self.kept = kept
        self.place = np.cumsum(kept) - 1
        self.sampled = order[kept]

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of right-aligned patterns (n x width, padded on the left)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for back in range(1, width + 1):
            live = np.flatnonzero((length >= back) & (low < high))
            if not len(live):
                continue
            c = patterns[live, width - back]
            low[live] = self.count[c] + self.tree.rank(c, low[live])
            high[live] = self.count[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.kept[rows])
        while len(todo):
            r = rows[todo]
            c = self.bwt[r]
            rows[todo] = self.count[c] + self.tree.rank(c, r)
            steps[todo] += 1
            todo = todo[~self.kept[rows[todo]]]
        return self.sampled[self.place[rows]] + steps
