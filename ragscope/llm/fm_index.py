"""FM-index over a shard of tokenised text, with numpy.

The text is an array of symbols: 0 separates (a document's end, or words that
no pattern has), 1..m are the words that patterns are made of.  Each 0 counts as
a symbol of its own, ordered by position, so suffixes compare up to their first
separator and nothing is found across one.

The last column of the sorted suffixes is kept as a wavelet matrix; a pattern is
searched backwards, two rank queries a symbol, for all patterns at once.
Occurrences are located by walking back to the nearest sampled suffix position.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, top: int) -> np.ndarray:
    """Suffix array of ``text`` (symbols 0..top): one sort by as many symbols as
    a 64-bit key holds, then doubling over the suffixes not yet told apart."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(top).bit_length())
    depth = max(1, 63 // bits)
    key = np.zeros(n, dtype=np.int64)
    open_ = np.ones(n, dtype=bool)  # no separator so far
    for j in range(depth):
        part = np.zeros(n, dtype=np.int64)
        part[: n - j] = text[j:]
        part[~open_] = 0
        open_ &= part > 0
        key = (key << bits) | part
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], (sorted_key[1:] != sorted_key[:-1]) | ~open_[order][1:]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    while True:
        group = np.flatnonzero(head)
        size = np.diff(np.append(group, n))
        rank[order] = np.repeat(group, size)
        todo = np.flatnonzero(np.repeat(size > 1, size))
        if not len(todo):
            return order
        own = order[todo]
        second = rank[np.minimum(own + depth, n)]
        own_rank = rank[own]
        again = np.lexsort((second, own_rank))
        order[todo] = own[again]
        s, r = second[again], own_rank[again]
        head[todo] = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
        depth *= 2


class WaveletMatrix:
    """rank(c, i): how many of the first i symbols are c."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            ones = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((c >> level) & 1).astype(bool)
            before_lo, before_hi = self.ones[k][lo].astype(np.int64), self.ones[k][hi].astype(np.int64)
            lo = np.where(one, self.zeros[k] + before_lo, lo - before_lo)
            hi = np.where(one, self.zeros[k] + before_hi, hi - before_hi)
        return hi - lo


class FMIndex:
    def __init__(self, text: np.ndarray, top: int, sample: int = 16):
        self.n = len(text)
        order = suffix_order(text, top)
        last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])  # suffixes by first symbol
        # position 0 is sampled and has no symbol before it; 0 is never searched
        last[order == 0] = 0
        self.last = last
        self.ranks = WaveletMatrix(last, top)
        kept = (order % sample == 0) | (last == 0)
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.position = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the patterns (one a row, all of one length, symbols > 0)."""
        count = len(patterns)
        lo, hi = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        live = np.arange(count)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            both = self.ranks.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.before[c] + both[: len(c)], self.before[c] + both[len(c):]
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes by their place in the sorted order."""
        out, rows = np.zeros(len(rows), np.int64), rows.copy()
        left, steps = np.arange(len(rows)), 0
        while len(left):
            done = self.kept[rows[left]]
            at = left[done]
            out[at] = self.position[self.kept_before[rows[at]]] + steps
            left = left[~done]
            c = self.last[rows[left]].astype(np.int64)
            rows[left] = self.before[c] + self.ranks.rank(c, rows[left])
            steps += 1
        return out

    def occurrences(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, position) of every occurrence."""
        lo, hi = self.search(patterns)
        count = hi - lo
        which = np.repeat(np.arange(len(patterns)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return which, self.locate(rows)
