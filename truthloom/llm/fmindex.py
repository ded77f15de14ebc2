"""A compressed FM-index over word symbols, searched for many patterns at once in numpy.

The Burrows-Wheeler transform is held in a wavelet matrix of packed bits with block counts.
Suffixes are sorted by their first 32 symbols, enough for patterns of up to 32.
"""

from __future__ import annotations

import numpy as np

DEPTH = 32


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys, from 1."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.ones(len(keys), np.int64)
    fresh[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _after(ranks: np.ndarray, step: int) -> np.ndarray:
    """The rank ``step`` places on; 0 past the end."""
    out = np.zeros(len(ranks), np.int64)
    out[: len(ranks) - step] = ranks[step:]
    return out


class WaveletMatrix:
    """Counts of a symbol before a place, for arrays of symbols and places."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.words, self.blocks, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (now >> level) & 1
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        self.base = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            block, bit = places >> 6, (places & 63).astype(np.uint64)
            mask = (np.uint64(1) << bit) - np.uint64(1)
            ones = self.blocks[i][block] + np.bitwise_count(self.words[i][block] & mask)
            places = np.where((symbols >> level) & 1, self.zeros[i] + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self._walk(symbols, places) - self.base[symbols]


class FMIndex:
    """Index of a text of symbols 0..size-1 that ends with the separator 0, which no pattern has.
    ``width`` (17 to 32) is the pattern length of interest."""

    def __init__(self, text: np.ndarray, size: int, width: int):
        if not 16 < width <= DEPTH:
            raise ValueError("width must be 17 to 32")
        self.width = width
        ranks, half = _ranks(text), None
        for step in (1, 2, 4, 8, 16):
            half = ranks if step == 16 else half
            ranks = _ranks(ranks * (len(text) + 1) + _after(ranks, step))
        self.suffixes = np.argsort(ranks, kind="stable").astype(np.int32)
        del ranks
        before = np.where(self.suffixes > 0, text[self.suffixes - 1], 0)
        self.bwt = WaveletMatrix(before, size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.text, self.size, self.common = text, len(text), None
        self.low, self.high, _ = self._groups(half, width - 1)
        _, _, self.group = self._groups(half, width)

    def _groups(self, half: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row: bounds and number of the rows whose suffixes share ``depth`` symbols."""
        a, b = half[self.suffixes], _after(half, depth - 16)[self.suffixes]
        fresh = np.ones(self.size, bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(fresh)
        number = np.cumsum(fresh) - 1
        bounds = starts[number], np.append(starts[1:], self.size)[number], number
        return tuple(x.astype(np.int32) for x in bounds)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: rows of the patterns with ``symbols`` put in front."""
        start = self.first[symbols]
        return start + self.bwt.rank(symbols, low), start + self.bwt.rank(symbols, high)

    def bounds(self, rows: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that share their first ``depths`` symbols with each of ``rows``."""
        if self.common is None:  # symbols that neighbouring rows share, up to the width
            self.common = np.zeros(self.size, np.int8)
            alike = np.arange(1, self.size)
            for step in range(self.width):
                above, below = self.suffixes[alike - 1] + step, self.suffixes[alike] + step
                inside = np.maximum(above, below) < self.size
                alike, above, below = alike[inside], above[inside], below[inside]
                alike = alike[self.text[above] == self.text[below]]
                self.common[alike] += 1
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.size)
        for depth in np.unique(depths[depths > 0]).tolist():
            own = depths == depth
            breaks = np.append(np.flatnonzero(self.common < depth), self.size)
            at = np.searchsorted(breaks, rows[own], "right")
            low[own], high[own] = breaks[at - 1], breaks[at]
        return low, high

    def matches(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of many sequences, streamed from their ends: for each position of
        ``text`` the rows of the index that match ``width`` symbols from there (empty: none do).

        A pattern that has reached the full width, or has no rows, loses symbols at its end (its
        rows widen to all that share the rest) and then grows at the front.
        """
        low, high = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        live = np.flatnonzero(np.diff(first) > 0)
        at, stop = first[1:][live] - 1, first[:-1][live]
        rows = np.zeros(len(live), np.int64), np.full(len(live), self.size)
        length = np.zeros(len(live), np.int64)
        while len(at):
            full = length == self.width
            length = length - full
            a0, b0 = np.where(full, self.low[rows[0]], rows[0]), np.where(full, self.high[rows[0]], rows[1])
            a, b = self.extend(text[at], a0, b0)
            lost = np.flatnonzero(a >= b)
            while len(lost):  # never while the index holds the sequences themselves
                done = lost[length[lost] == 0]  # the symbol is not in the index
                length[done], a[done], b[done] = -1, 0, self.size
                lost = lost[length[lost] > 0]
                length[lost] -= 1
                wider = self.bounds(a0[lost], length[lost])
                a[lost], b[lost] = self.extend(text[at[lost]], *wider)
                lost = lost[a[lost] >= b[lost]]
            length += 1
            reached = length == self.width
            low[at[reached]], high[at[reached]] = a[reached], b[reached]
            going = at > stop
            at, stop, length, rows = at[going] - 1, stop[going], length[going], (a[going], b[going])
        return low, high
