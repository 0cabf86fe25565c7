"""An FM-index over a string of word numbers: backward search by wavelet-matrix ranks, positions from a sampled suffix array.

Symbol 0 parts stretches of the string and matches nothing.  All functions work on many patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

from tierbook.llm.suffixes import doubled

SAMPLE = 16


class Bits:
    """A bit string with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def ones(self, upto: np.ndarray) -> np.ndarray:
        word = upto >> 6
        low = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Ranks and symbols of a string of small numbers, one bit string per binary digit, high digit first."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels, self.zeros = [], []
        self.digits = max(1, int(largest).bit_length())
        for d in range(self.digits - 1, -1, -1):
            bit = (symbols >> d) & 1
            self.levels.append(Bits(bit.astype(bool)))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(1 << self.digits)
        self.first = self._descend(every, np.zeros(len(every), np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            one = (symbol >> (self.digits - 1 - k)) & 1
            ones = level.ones(place)
            place = np.where(one == 1, self.zeros[k] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._descend(symbol, upto) - self.first[symbol]

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and their ranks there."""
        symbol = np.zeros(len(place), np.int64)
        for k, level in enumerate(self.levels):
            one = level.at(place).astype(np.int64)
            ones = level.ones(place)
            symbol = symbol << 1 | one
            place = np.where(one == 1, self.zeros[k] + ones, place - ones)
        return symbol, place - self.first[symbol]


class Index:
    def __init__(self, text: np.ndarray, largest: int):
        if not len(text) or text[-1]:  # the last symbol has no row that follows it, so it must be one that is never sought
            text = np.append(text, 0)
        n = len(text)
        counts = np.bincount(text, minlength=largest + 1)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])[:-1]
        suffix = doubled(self.smaller[text])
        before = np.where(suffix > 0, text[suffix - 1], 0)
        self.last = Wavelet(before.astype(np.int64), largest)
        # rows whose place is kept: every SAMPLE-th place, and where a stretch begins, as nothing is before it
        kept = (suffix % SAMPLE == 0) | (before == 0)
        self.kept, self.places = Bits(kept), suffix[kept]
        self.size = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of the suffixes that start with each pattern; patterns share one length."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low[alive] = self.smaller[c] + self.last.rank(c, low[alive])
            high[alive] = self.smaller[c] + self.last.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes in these rows."""
        out, rows, open_ = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        for steps in range(SAMPLE):
            here = self.kept.at(rows) == 1
            out[open_[here]] = self.places[self.kept.ones(rows[here])] + steps
            rows, open_ = rows[~here], open_[~here]
            if not len(rows):
                break
            symbol, rank = self.last.at(rows)
            rows = self.smaller[symbol] + rank
        return out
