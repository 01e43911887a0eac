"""FM-index over word sequences: a wavelet matrix of the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Bits:
    """Packed bits with a running count for each 64 of them."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, U64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        low = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(top).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate((values[~bit], values[bit]))
        symbols = np.arange(top + 1)
        self.first = np.zeros(top + 1, np.int64)
        self.first = self._down(symbols, self.first.copy())

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for j, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = bits.ones(i)
            i = np.where((symbol >> (self.depth - 1 - j)) & 1 == 1, zeros + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i values."""
        return self._down(symbol, i) - self.first[symbol]


class FMIndex:
    """Of a sequence of symbols >= 1 with 0 between texts, for patterns of up to `depth` symbols.

    Suffixes are ordered by their first `depth` symbols at least, which is all that intervals of
    such patterns depend on.
    """

    def __init__(self, sequence: np.ndarray, depth: int):
        n, rank, size = len(sequence), sequence.astype(np.int64), 1
        while size < depth:
            shifted = np.zeros(n, np.int64)
            shifted[:-size] = rank[size:] + 1
            known, rank = np.unique(rank * (n + 2) + shifted, return_inverse=True)
            size *= 2
            if len(known) == n:
                break
        self.suffixes = np.argsort(rank, kind="stable")
        bwt = sequence[self.suffixes - 1]
        top = int(sequence.max(initial=0))
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=top + 1))))
        self.tree = WaveletMatrix(bwt, top)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern, from those of the patterns."""
        at = self.starts[symbol]
        return at + self.tree.rank(symbol, low), at + self.tree.rank(symbol, high)

    def matching(self, sequence: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each end position of a streamed sequence, as far as `least` symbols.

        Returns (which ends match `least` symbols at two places or more, low, high): the matching
        statistic of the others is shorter.
        """
        alive = np.arange(len(ends))
        symbol = sequence[ends - 1]
        low, high = self.starts[symbol], self.starts[symbol + 1]
        for j in range(2, least + 1):
            more = high - low > 1
            alive, low, high = alive[more], low[more], high[more]
            low, high = self.extend(sequence[ends[alive] - j], low, high)
        more = high - low > 1
        return alive[more], low[more], high[more]
