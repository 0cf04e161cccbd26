"""A compressed FM-index over integer symbols, searched for many patterns in lockstep.

The Burrows-Wheeler transform of the text lies in a wavelet matrix: one plane of
packed bits for each bit of a symbol, with a running count for every 64 bits.  A
backward step maps an interval of the suffix order to that of the pattern with one
more symbol in front, at two rank queries a plane, for all patterns at once.

Suffixes are ordered by their first ``depth`` symbols only, which is all that
patterns of up to ``depth`` symbols need: rows that start with such a pattern are
still contiguous, and a backward step only counts rows before and inside an interval.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank queries over a sequence of small integers."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits, self.count, self.zeros = [], [], []
        now = symbols
        for level in reversed(range(self.levels)):
            one = (now >> level & 1).astype(bool)
            packed = np.zeros(self.n // 64 + 1, np.uint64)
            octets = np.packbits(one, bitorder="little")
            packed.view(np.uint8)[: len(octets)] = octets
            self.bits.append(packed)
            self.count.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.uint32 if self.n < 1 << 32 else np.int64))
            self.zeros.append(self.n - int(one.sum()))
            now = np.concatenate([now[~one], now[one]])
        # where each symbol's occurrences begin (or would) in the last plane's order
        self.start = self._walk(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._walk(symbol, at) - self.start[symbol]

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.count[k][word].astype(np.int64) + np.bitwise_count(self.bits[k][word] & below)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Intervals of the suffix order of ``text`` (symbols of 1 and more, 0 separates).

    Kept are the bit planes of the transform, where each symbol's rows begin, a mark at
    each row that differs from the one before in its first ``depth - 1`` symbols, and the
    smallest position in rows that a caller asks for; neither text nor suffix order stay.
    """

    def __init__(self, text: np.ndarray, depth: int, position: np.ndarray):
        self.n = n = len(text)
        # suffixes by their first 1, 2, 4, ... symbols, as ranks
        ranks = [text.astype(np.int64)]
        order = np.argsort(text, kind="stable")
        while 1 << (len(ranks) - 1) < depth:
            last, half = ranks[-1], 1 << (len(ranks) - 1)
            after = np.zeros(n, np.int64)
            after[: max(0, n - half)] = last[half:] + 1
            key = last * (int(last.max(initial=0)) + 2) + after
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, np.int64)
            run = key[order]
            fresh[order] = np.cumsum(np.append(False, run[1:] != run[:-1])) if n else 0
            ranks.append(fresh)
        self.marks = np.packbits(self._differ(ranks, order, depth - 1), bitorder="little")
        self.place = position[order]
        self.bwt = WaveletMatrix(text[order - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1))])

    def _differ(self, ranks: list[np.ndarray], order: np.ndarray, length: int) -> np.ndarray:
        """Whether each row differs from the one before in its first ``length`` symbols, put together from powers of two."""
        a, b = order[:-1], order[1:]
        same, at = np.ones(len(a), bool), 0
        for k in reversed(range(len(ranks))):
            if length - at >= 1 << k:
                r = np.append(ranks[k], np.full(at + 1, -1))
                same &= r[np.minimum(a + at, self.n)] == r[np.minimum(b + at, self.n)]
                at += 1 << k
        return np.append(True, ~same)

    def everything(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(k, np.int64), np.full(k, self.n)

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with ``symbol`` put in front."""
        at = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.first[symbol]
        return base + at[: len(low)], base + at[len(low) :]

    def parents(self) -> np.ndarray:
        """Where the intervals of all patterns of depth - 1 symbols begin."""
        return np.append(np.flatnonzero(np.unpackbits(self.marks, count=self.n, bitorder="little")), self.n)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest position in each interval; different intervals must be disjoint."""
        begin, at, back = np.unique(low, return_index=True, return_inverse=True)
        if not len(begin):
            return np.zeros(0, np.int64)
        ends = np.stack([begin, high[at]], 1).ravel()
        return np.minimum.reduceat(np.append(self.place, np.iinfo(np.int64).max), ends)[::2][back]


def window_firsts(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, position: np.ndarray, window: int) -> np.ndarray:
    """For each place in ``text``, the smallest position of an equal window of symbols (its own, if none is smaller).

    ``text`` holds segments [start, end) with 0 between them.  The segments are
    streamed through an FM-index of the text from their ends: the last window by one
    backward step for each symbol, every further one by dropping its last symbol (the
    parent interval, of all rows that share the first window - 1 symbols) and one backward
    step.  The interval that the search ends in holds all occurrences of the window.
    Places at which no window of a segment starts keep the largest integer.
    """
    out = np.full(len(text), np.iinfo(np.int64).max)
    index = FMIndex(text, window, position)
    parents = index.parents()
    live = np.flatnonzero(ends - starts >= window)
    at = ends[live].copy()
    low, high = index.everything(len(live))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in range(int((ends - starts).max(initial=0))):
        at -= 1
        low, high = index.extend(low, high, text[at])
        if step >= window - 1:
            found.append((at.copy(), low, high))
            stay = at > starts[live]
            live, at, low = live[stay], at[stay], low[stay]
            if not len(live):
                break
            above = np.searchsorted(parents, low, "right") - 1
            low, high = parents[above], parents[above + 1]
    if found:
        where, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        out[where] = index.least(low, high)
    return out
