"""An FM-index over a collection of strings of numbers.

The strings lie one after the other, each closed by the number 0, and the first 0 stands
before them.  Suffixes are ordered up to the 0 that closes them and then by place, so
every 0 is a symbol of its own.  Ranks come from a wavelet matrix over the transform,
places from sampled suffixes.  All work is done for many patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

#: Every so many places of the text, and at the beginning of each string, a suffix is sampled.
RATE = 8


class Bits:
    """A bit sequence with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros((len(bits) >> 6) + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0

    def ones(self, place: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[place >> 6] + np.bitwise_count(self.words[place >> 6] & low)


class Wavelet:
    """A wavelet matrix: the numbers bit by bit from the highest, zeros before ones on each level."""

    def __init__(self, numbers: np.ndarray, width: int):
        self.levels = []
        for shift in range(width - 1, -1, -1):
            bits = (numbers >> shift) & 1 != 0
            self.levels.append((shift, Bits(bits)))
            numbers = np.concatenate([numbers[~bits], numbers[bits]])

    @staticmethod
    def _down(level: Bits, place: np.ndarray, bit: np.ndarray) -> np.ndarray:
        ones = level.ones(place)
        return np.where(bit, level.zeros + ones, place - ones)

    def rank(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each number occurs before its place."""
        first = np.zeros(len(place), np.int64)
        for shift, level in self.levels:
            bit = (number >> shift) & 1 != 0
            first, place = self._down(level, first, bit), self._down(level, place, bit)
        return place - first

    def number_and_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number at each place, and how often it occurs before."""
        first, number = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for shift, level in self.levels:
            bit = level.at(place)
            number |= bit.astype(np.int64) << shift
            first, place = self._down(level, first, bit), self._down(level, place, bit)
        return number, place - first


def suffix_order(text: np.ndarray, width: int) -> np.ndarray:
    """The places of ``text`` in the order of their suffixes.

    Suffixes are first sorted by as many numbers as fit into 64 bits, then, where that
    leaves ties that no closing 0 settles, by twice as many each time.
    """
    n = len(text)
    known = min(n, 63 // width)
    closing = np.flatnonzero(text == 0)
    until = closing[np.searchsorted(closing, np.arange(n))] - np.arange(n)  # numbers before the closing 0
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(known):
        key <<= width
        key[: n - k] |= np.where(open_[: n - k], text[k:], 0)
        open_[: n - k] &= text[k:] != 0
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        tied = np.append(~new[1:], False) | ~new  # rows whose neighbour has an equal beginning
        rows = np.flatnonzero(tied)
        rows = rows[until[order[rows]] >= known]
        if not len(rows):
            return order
        places = order[rows]
        key = rank[places] * n + rank[places + known]
        by_key = np.argsort(key, kind="stable")
        order[rows] = places[by_key]
        key = key[by_key]
        changed = np.append(True, key[1:] != key[:-1])
        new[rows] |= changed
        rank[order[rows]] = np.maximum.accumulate(np.where(new[rows], rows, 0))
        known *= 2


class Index:
    """``text`` begins and ends with 0; its other numbers are below 2^width."""

    def __init__(self, text: np.ndarray, width: int):
        order = suffix_order(text, width)
        before = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << width))])
        self.wavelet = Wavelet(before, width)
        marked = (order % RATE == 0) | (before == 0)
        self.marked, self.samples, self.size = Bits(marked), order[marked], len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, last row + 1) of the patterns that occur; a pattern is a line of numbers above 0."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for step in range(patterns.shape[1] - 1, -1, -1):
            number = patterns[which, step].astype(np.int64)
            low = self.first[number] + self.wavelet.rank(number, low)
            high = self.first[number] + self.wavelet.rank(number, high)
            found = low < high
            which, low, high = which[found], low[found], high[found]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of the suffix of each row."""
        out, walked = np.empty(len(rows), np.int64), np.arange(len(rows))
        steps = 0
        while len(walked):
            done = self.marked.at(rows)
            out[walked[done]] = self.samples[self.marked.ones(rows[done])] + steps
            rows, walked = rows[~done], walked[~done]
            number, rank = self.wavelet.number_and_rank(rows)
            rows = self.first[number] + rank
            steps += 1
        return out
