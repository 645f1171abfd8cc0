"""An FM-index over integer symbols: suffix order by prefix doubling, ranks from a wavelet matrix, sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: In a text, ends each run; no pattern has it.
END = 0
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of suffixes in order. Runs are compared up to their END; ENDs are ordered by their places, so no two suffixes tie."""
    n = len(text)
    ends = text == END
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    h = 1
    while True:
        order = np.argsort(rank, kind="stable")
        own = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], own[1:] != own[:-1])))
        if not n or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:-h] = rank[h:] + 1
        rank = rank * (n + 1) + after
        h *= 2


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for bit in reversed(range(max(1, (sigma - 1).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start = np.zeros_like(at)
        for bit, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            at = np.where(one, zeros + before[at], at - before[at])
            start = np.where(one, zeros + before[start], start - before[start])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for bit, before, zeros in self.levels:
            one = before[at + 1] - before[at]
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, zeros + before[at], at - before[at])
        return symbol


class FMIndex:
    """text: runs of symbols of 1 to sigma - 1, each followed by END."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_order(text)
        self.size = len(text)
        self.bwt = WaveletMatrix(text[order - 1].astype(np.int64), sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        # The first symbol of each run is a sample too, so no walk passes an END.
        firsts = np.concatenate(([True], text[:-1] == END)) if len(text) else np.zeros(0, bool)
        marked = (order % SAMPLE == 0) | firsts[order]
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.samples = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows of each pattern; patterns are right-aligned rows of one matrix."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for step in range(1, patterns.shape[1] + 1):
            alive = alive[(lengths[alive] >= step) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = patterns[alive, -step].astype(np.int64)
            low[alive] = self.before[symbol] + self.bwt.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.bwt.rank(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows start: steps back to the next sampled one."""
        place, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        rows = rows.astype(np.int64)
        while len(open_):
            done = self.marks[rows + 1] > self.marks[rows]
            place[open_[done]] = self.samples[self.marks[rows[done]]] + steps[open_[done]]
            open_, rows = open_[~done], rows[~done]
            steps[open_] += 1
            symbol = self.bwt.access(rows)
            rows = self.before[symbol] + self.bwt.rank(symbol, rows)
        return place
