"""A word-level FM-index, built in a task over one shard of documents.

Symbols are small integers; 0 is the separator. The suffix array is made by prefix doubling, the Burrows-Wheeler transform is held as a
wavelet matrix (one bit vector for each bit of a symbol) with prefix counts, and one suffix position in STEP is kept.
"""

from __future__ import annotations

import numpy as np

STEP = 8


def suffix_array(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least (whole suffixes if None); a shorter suffix comes first."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while width < (depth or n):
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - width)] = rank[width:] + 1
        key = rank * np.int64(n + 1) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if n == 0 or new[-1] == n - 1:
            break
    return order


class Wavelet:
    """Ranks over a sequence of symbols below 2 ** bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        seq = seq.copy()
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        # after the last level the symbols stand in runs; where each begins
        self.run = np.zeros(1 << bits, np.int64)
        if len(seq):
            begins = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            self.run[seq[begins]] = begins

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often `symbol` occurs before position i."""
        lo, hi = np.zeros_like(i), i
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            ones = self.ones[level]
            a, z = ones[lo], ones[hi]
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + z, hi - z)
        return hi - lo


class Index:
    def __init__(self, symbols: np.ndarray):
        symbols = np.append(symbols + 1, 0)  # the end is a symbol of its own, below all others
        n = len(symbols)
        suffixes = suffix_array(symbols)
        self.last = symbols[suffixes - 1]
        top = int(symbols.max()) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top))))
        self.top = top
        self.wavelet = Wavelet(self.last, max(1, int(top).bit_length()))
        self.kept = suffixes % STEP == 0
        self.place = suffixes[self.kept]
        self.before = np.concatenate(([0], np.cumsum(self.kept)))
        self.n = n

    def back(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.rank(symbol, i)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each phrase (a row of phrases, right-aligned); empty where lo >= hi."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1] if len(phrases) else 0
        for back in range(1, width + 1):
            symbol = phrases[:, width - back] + 1
            known = symbol < self.top
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            gone = live[~known[live]]
            hi[gone] = lo[gone]
            live = live[known[live]]
            lo[live], hi[live] = self.back(symbol[live], lo[live]), self.back(symbol[live], hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes at these rows start: steps backwards to a kept position."""
        out, rows, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            there = self.kept[at]
            done = open_[there]
            out[done] = self.place[self.before[rows[done]]] + steps[done]
            open_ = open_[~there]
            if len(open_):
                at = rows[open_]
                rows[open_] = self.back(self.last[at], at)
                steps[open_] += 1
        return out
