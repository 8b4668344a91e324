"""A full-text index in minute space over integer sequences, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

#: Every so many text positions one is kept for locating matches.
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of `text` in their order, by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        if width < n:
            second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if width >= n or rank[order[-1]] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Symbols by bit levels; rank and access by prefix sums, for arrays of queries."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones_before = bits, [], []
        level = symbols
        for bit in range(bits - 1, -1, -1):
            one = (level >> bit) & 1
            before = np.zeros(len(level) + 1, np.int32)
            np.cumsum(one, out=before[1:])
            self.ones_before.append(before)
            self.zeros.append(len(level) - int(before[-1]))
            level = np.concatenate([level[one == 0], level[one == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at
        for i, before in enumerate(self.ones_before):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            ones_low, ones_high = before[low], before[high]
            low = np.where(one, self.zeros[i] + ones_low, low - ones_low)
            high = np.where(one, self.zeros[i] + ones_high, high - ones_high)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol = np.zeros_like(at)
        for i, before in enumerate(self.ones_before):
            one = before[at + 1] - before[at]
            symbol = symbol * 2 + one
            at = np.where(one == 1, self.zeros[i] + before[at], at - before[at])
        return symbol


class FMIndex:
    """The Burrows-Wheeler transform of a text of symbols from 1, with a wavelet matrix and sampled positions."""

    def __init__(self, text: np.ndarray):
        text = np.concatenate([text, [0]]).astype(np.int64)  # 0 ends the text and is least
        order = suffix_array(text)
        bwt = text[order - 1]
        top = int(text.max())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletMatrix(bwt, max(1, top.bit_length()))
        self.top, self.size = top, len(text)
        self.sampled = order % SAMPLE == 0
        self.samples = order[self.sampled]
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])

    def _back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, at)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [low, high) of each row of `patterns`, by backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            known = symbol <= self.top
            low[alive[~known]] = high[alive[~known]] = 0
            alive, symbol = alive[known], symbol[known]
            low[alive], high[alive] = self._back(symbol, low[alive]), self._back(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix: steps back to a sampled one."""
        rows, position = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        steps = 0
        while len(open_):
            here = rows[open_]
            found = self.sampled[here]
            position[open_[found]] = self.samples[self.sampled_before[here[found]]] + steps
            open_, here = open_[~found], here[~found]
            rows[open_] = self._back(self.tree.access(here), here)
            steps += 1
        return position
