"""FM-index over integer symbols: wavelet matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; ``text`` must make every suffix distinct, which distinct separators do.

    After the first sort only suffixes whose rank isn't unique yet are sorted again, by twice as many symbols each time.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    starts = np.flatnonzero(np.r_[True, sorted_text[1:] != sorted_text[:-1]])
    rank = np.empty(n, np.int64)
    sizes = np.diff(np.r_[starts, n])
    rank[order] = np.repeat(starts, sizes)  # a group's rank is the place of its first member
    width = 1
    open_at = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    while len(open_at):
        members = order[open_at]
        far = members + width
        second = np.where(far < n, rank[np.minimum(far, n - 1)], -1)
        first = rank[members]
        by = np.lexsort((second, first))
        members, first, second = members[by], first[by], second[by]
        order[open_at] = members
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(members)])
        rank[members] = np.repeat(open_at[begin], size)
        open_at = open_at[np.repeat(size, size) > 1]
        width *= 2
    return order


class WaveletMatrix:
    """Ranks and access over symbols below ``2 ** levels``."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        at = symbols
        for k in range(levels - 1, -1, -1):
            bit = (at >> k) & 1
            ones = np.zeros(len(at) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(at) - int(ones[-1]))
            at = np.concatenate([at[bit == 0], at[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - level)) & 1
            low_one, high_one = ones[low], ones[high]
            low = np.where(bit == 1, zeros + low_one, low - low_one)
            high = np.where(bit == 1, zeros + high_one, high - high_one)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol, low, high = np.zeros_like(at), np.zeros_like(at), at.copy()
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[high + 1] - ones[high]
            symbol = symbol * 2 + bit
            low_one, high_one = ones[low], ones[high]
            low = np.where(bit == 1, zeros + low_one, low - low_one)
            high = np.where(bit == 1, zeros + high_one, high - high_one)
        return symbol, high - low


class FmIndex:
    """Index of runs of symbols 1..``sigma``, each closed by a separator (0).

    Separators differ from one another in the sort (by their place), so every suffix is distinct and the walk from a row
    to the row of the suffix before it is exact.  Run starts and every ``step``-th place are sampled, so a walk never
    crosses a separator.
    """

    def __init__(self, text: np.ndarray, sigma: int, step: int = 8):
        n = len(text)
        separators = np.flatnonzero(text == 0)
        distinct = text.astype(np.int64) + len(separators)
        distinct[separators] = np.arange(len(separators))
        order = suffix_array(distinct)
        self.n, self.sigma = n, sigma
        self.first = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma + 1), out=self.first[1:])
        self.bwt = WaveletMatrix(text[order - 1].astype(np.int64), max(1, int(sigma).bit_length()))
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[separators[separators + 1 < n] + 1] = True
        sampled = (order % step == 0) | starts[order]
        self.sampled = np.zeros(n + 1, np.int64)
        np.cumsum(sampled, out=self.sampled[1:])
        self.places = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern; ``patterns`` is padded on the right."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - back]
            low[live] = self.first[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.bwt.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes at these rows."""
        rows, out, walked = rows.copy(), np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            known = self.sampled[at + 1] > self.sampled[at]
            out[live[known]] = self.places[self.sampled[at[known]]] + walked
            live = live[~known]
            symbol, rank = self.bwt.access(rows[live])
            rows[live] = self.first[symbol] + rank
            walked += 1
        return out
