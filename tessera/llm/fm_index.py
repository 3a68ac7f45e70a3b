"""A compressed FM-index of a text of integers whose suffixes are sorted by their first k symbols, and matching statistics on it."""

from __future__ import annotations

import numpy as np

_ALL = ~np.uint64(0)
_ONE = np.uint64(1)


def _ranked(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def _below(at: np.ndarray) -> np.ndarray:
    """Masks of the bits below place at (of 0 to 63)."""
    return (_ONE << at.astype(np.uint64)) - _ONE


class Bits:
    """A compressed bit vector with rank and select: of words of 64 equal bits only their counts are kept."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.int32)
        mixed = (words != 0) & (words != _ALL)
        self.words = words[mixed]
        flags = np.zeros((len(words) // 64 + 1) * 64, np.uint8)
        flags[: len(words)] = mixed
        self.mixed = np.packbits(flags, bitorder="little").view(np.uint64)
        self.mixed_before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.mixed), dtype=np.int64))).astype(np.int32)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.before, self.words, self.mixed, self.mixed_before))

    def word(self, k: np.ndarray) -> np.ndarray:
        """The k-th words."""
        block, place = k >> 6, (k & 63).astype(np.uint64)
        flag = self.mixed[block]
        out = np.where(self.before[k + 1] - self.before[k] == 64, _ALL, np.uint64(0))
        some = np.flatnonzero((flag >> place) & _ONE)
        out[some] = self.words[self.mixed_before[block[some]] + np.bitwise_count(flag[some] & _below(place[some]))]
        return out

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones are before each place."""
        k = at >> 6
        return self.before[k] + np.bitwise_count(self.word(k) & _below(at & 63))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.word(at >> 6) >> (at & 63).astype(np.uint64)) & _ONE

    def select(self, n: np.ndarray) -> np.ndarray:
        """The place of the n-th one, counted from 0; behind the last word if there are no so many."""
        k = np.searchsorted(self.before, n, side="right") - 1
        out = np.full(len(n), (len(self.before) - 1) * 64)
        there = np.flatnonzero(k < len(self.before) - 1)
        word, left = self.word(k[there]), n[there] - self.before[k[there]]
        place = np.zeros(len(there), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & ((_ONE << np.uint64(half)) - _ONE)).astype(np.int64)
            up = left >= low
            left = np.where(up, left - low, left)
            word = np.where(up, word >> np.uint64(half), word)
            place += np.where(up, half, 0)
        out[there] = k[there] * 64 + place
        return out


class FMIndex:
    """Backward search over a wavelet matrix of compressed bit vectors, for patterns of up to k symbols.

    Symbols are 64-bit hashes. Suffixes that agree in k symbols stand in order of position, so the first row
    of the interval of a pattern of k symbols is its first occurrence. A bit for each row tells whether its first k - 1
    symbols are others than those of the row before: by rank and select it gives the interval that matching
    statistics need to move on by one position. Of the suffix array only the samples are kept that are asked for: the
    first rows of the intervals of k symbols that have several. (Rows that agree in k symbols can't be walked back
    from, as their order isn't that of their further symbols.)
    """

    def __init__(self, text: np.ndarray, k: int):
        self.n, self.k = len(text), k
        self.alphabet, symbols = np.unique(text, return_inverse=True)
        symbols = symbols.astype(np.int64)
        rank, size, kept = {1: symbols}, 1, symbols
        while 2 * size <= k:
            kept = _ranked(kept * (self.n + 1) + self._ahead(kept, size))
            size *= 2
            rank[size] = kept

        def of_length(m: int) -> np.ndarray:
            part = max(s for s in rank if s <= m)
            if part == m:
                return rank[part]
            rest = min((s for s in rank if part + s >= m), default=part)
            return _ranked(rank[part] * (self.n + 1) + self._ahead(rank[rest], m - rest))

        whole, parent = of_length(k), of_length(k - 1)
        rank.clear()
        order = np.argsort(whole, kind="stable")
        whole = whole[order]
        new = np.concatenate(([True], whole[1:] != whole[:-1], [True]))
        head = new[:-1] & ~new[1:]
        del whole
        parent = parent[order]
        self.parent = Bits(np.concatenate(([True], parent[1:] != parent[:-1])))
        del parent
        self.sampled, self.samples = Bits(head), order[head].astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=len(self.alphabet)))))
        self._wavelet(symbols[order - 1])

    def nbytes(self) -> int:
        return sum(b.nbytes() for _, b, _ in self.levels) + self.parent.nbytes() + self.sampled.nbytes() + self.samples.nbytes + self.alphabet.nbytes + self.first.nbytes + self.offset.nbytes

    def _ahead(self, x: np.ndarray, by: int) -> np.ndarray:
        """x moved on by so many positions, 0 beyond the end and else one more."""
        out = np.zeros(self.n, np.int64)
        out[: max(0, self.n - by)] = x[by:] + 1
        return out

    def _wavelet(self, bwt: np.ndarray) -> None:
        levels = max(1, int(len(self.alphabet) - 1).bit_length())
        self.levels: list[tuple[int, Bits, int]] = []
        symbol_starts = np.zeros(len(self.alphabet), np.int64)
        codes = np.arange(len(self.alphabet))
        for level in range(levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            bits, zeros = Bits(bit), int(self.n - bit.sum())
            self.levels.append((level, bits, zeros))
            ones = bits.rank(symbol_starts)
            symbol_starts = np.where((codes >> level) & 1, zeros + ones, symbol_starts - ones)
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.offset = self.first[:-1] - symbol_starts

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern from those of the patterns."""
        n = len(low)
        at, both = np.concatenate([low, high]), np.concatenate([symbol, symbol])
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((both >> level) & 1, zeros + ones, at - ones)
        at = at + self.offset[both]
        return at[:n], at[n:]

    def parents(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first k - 1 symbols of rows."""
        group = self.parent.rank(low + 1)
        return self.parent.select(group - 1), np.minimum(self.parent.select(group), self.n)

    def repeats(self, text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every window of k symbols inside the given spans of a text (of symbols of the index) that comes several times
        in the index: its place and that of its first occurrence.

        The spans are streamed backwards, all at once: a backward step takes each on to the next symbol, and after a
        window is found the interval widens to that of its first k - 1 symbols.
        """
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        end = begin + length
        codes = np.searchsorted(self.alphabet, text).astype(np.int32)
        symbol = codes[end - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        places, firsts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for done in range(1, int(length[0]) + 1 if len(length) else 0):
            alive = int(np.searchsorted(-length, -done, side="right"))
            if done > 1:
                low, high = self.step(codes[end[:alive] - done], low[:alive], high[:alive])
            if done >= self.k:
                several = np.flatnonzero(high - low > 1)
                places.append(end[several] - done)
                firsts.append(self.samples[self.sampled.rank(low[several])])
                low, high = self.parents(low)
        return np.concatenate(places), np.concatenate(firsts).astype(np.int64)
