"""A run-length index of a set of strings: suffix order, the run-compressed Burrows-Wheeler transform, and suffix positions at the ends of
runs. These samples alone give, for every place of the text, its lexicographic predecessor and the length they share: from a sample on,
both move along with the place, the length falling by one each step. So matching statistics are streamed from left to right."""

from __future__ import annotations

import numpy as np


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the strings one after the other, each with an end of its own, smaller than all bytes; starts; lengths."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    owners = np.arange(len(strings))
    symbols = np.empty(int(lengths.sum()) + len(strings), np.int64)
    places = np.arange(int(lengths.sum())) + np.repeat(owners, lengths)
    symbols[places] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + len(strings)
    ends = np.cumsum(lengths + 1) - 1
    symbols[ends] = owners
    return symbols, ends - lengths, lengths


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    n = len(symbols)
    bits = int(symbols.max(initial=1)).bit_length()
    depth = max(1, min(7, 62 // bits))
    rank = symbols.copy()
    for i in range(1, depth):
        rank <<= bits
        rank[: max(0, n - i)] |= symbols[i:]
    while True:
        order = np.argsort(rank)
        own = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], own[1:] != own[:-1])))
        if not n or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - depth] = rank[depth:] + 1
        rank = rank * (n + 1) + after
        depth *= 2


def _common(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths that the suffixes at a and b share, eight bytes at a time; left: bytes from each place to its string's end."""
    words = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    most = np.minimum(left[a], left[b])
    found = most.copy()
    open_, at = np.nonzero(most > 0)[0], 0
    while len(open_):
        x = words[a[open_] + at] ^ words[b[open_] + at]
        differs = x != 0
        lowest = x[differs]
        lowest &= -lowest
        rows = open_[differs]
        found[rows] = np.minimum(found[rows], at + np.bitwise_count(lowest - np.uint64(1)) // 8)
        at += 8
        open_ = open_[~differs]
        open_ = open_[most[open_] > at]
    return found


class RunIndex:
    def __init__(self, strings: list[bytes]):
        symbols, self.starts, self.lengths = joined(strings)
        self.size = len(symbols)
        order = suffix_order(symbols)
        bwt = symbols[order - 1]
        heads = np.concatenate(([True], bwt[1:] != bwt[:-1])) if self.size else np.zeros(0, bool)
        rows = np.nonzero(heads)[0]
        #: Where runs of the transform start: places, and those of the row before.
        self.sampled = order[rows]
        self.before = order[rows - 1]
        owners = np.repeat(np.arange(len(strings)), self.lengths + 1)
        left = (self.starts + self.lengths)[owners] - np.arange(self.size)
        text = np.zeros(self.size + 15, np.uint8)
        inside = symbols >= len(strings)
        text[: self.size][inside] = symbols[inside] - len(strings)
        self.shared = _common(text, left, self.sampled, self.before)
        if self.size:
            self.shared[0] = 0  # no row before the first

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place its lexicographic predecessor and the length that they share."""
        last = np.full(self.size, -1, np.int64)
        last[self.sampled] = np.arange(len(self.sampled))
        here = np.where(last >= 0, np.arange(self.size), 0)
        np.maximum.accumulate(here, out=here)
        sample = last[here]
        moved = np.arange(self.size) - here
        return self.before[sample] + moved, self.shared[sample] - moved

    def repeated(self, length: int) -> np.ndarray:
        """Whether the length bytes from each place also start at an earlier one."""
        source, shared = self.matching_statistics()
        up = np.arange(self.size)
        linked = np.nonzero(shared >= length)[0]
        up[linked] = source[linked]
        open_ = linked
        while len(open_):
            further = up[up[open_]]
            moved = further != up[open_]
            up[open_] = further
            open_ = open_[moved]
        least = np.arange(self.size)
        np.minimum.at(least, up[linked], linked)
        out = np.zeros(self.size, bool)
        heads = np.unique(up[linked])
        out[linked] = linked > least[up[linked]]
        out[heads] = heads > least[heads]
        return out
