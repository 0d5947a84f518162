"""An FM-index over a sequence of symbols, searched for many patterns at once with whole-array operations."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; of two equal beginnings the shorter suffix comes first."""
    n = len(codes)
    rank, k = codes.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (int(rank.max(initial=0)) + 2 if k == 1 else n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])]) if n else []
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        k *= 2


class Bits:
    """A bit vector with rank: 64-bit blocks and their running counts."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)[:-1]])
        self.zeros = len(bits) - int(np.bitwise_count(self.blocks).sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.blocks[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """Of symbols 1 to ``top``; 0 parts what no pattern may cross. Inside all are one higher, for an end that is below all and unique."""

    def __init__(self, codes: np.ndarray, top: int, sample: int = 16):
        codes = np.append(codes.astype(np.int64) + 1, 0)
        top += 1
        order = suffix_array(codes)
        self.n = len(codes)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=top + 1))])
        last = codes[order - 1]
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (last >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones)))
            last = np.concatenate([last[~ones], last[ones]])
        kept = order % sample == 0
        self.sampled, self.places = Bits(kept), order[kept]

    def _rank(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each symbol before each place, by the wavelet matrix."""
        begin, at = np.zeros(len(symbol), np.int64), list(at)
        for bit, bits in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            for k, x in enumerate((begin, *at)):
                r = bits.rank(x)
                x = np.where(one, bits.zeros + r, x - r)
                if k:
                    at[k - 1] = x
                else:
                    begin = x
        return [x - begin for x in at]

    def _symbol(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for _, bits in self.levels:
            one = bits.get(at)
            r = bits.rank(at)
            symbol = symbol << 1 | one
            at = np.where(one, bits.zeros + r, at - r)
        return symbol

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patterns of one length, a row each: (pattern, place) of every occurrence."""
        patterns = patterns + 1
        alive = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            a, b = self._rank(symbol, lo, hi)
            lo, hi = self.less[symbol] + a, self.less[symbol] + b
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
        found = np.repeat(alive, hi - lo)
        row = np.repeat(lo, hi - lo) + np.arange(len(found)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        place, open_, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        while len(open_):
            known = self.sampled.get(row)
            place[open_[known]] = self.places[self.sampled.rank(row[known])] + steps
            open_, row = open_[~known], row[~known]
            symbol = self._symbol(row)
            row = self.less[symbol] + self._rank(symbol, row)[0]
            steps += 1
        return found, place
