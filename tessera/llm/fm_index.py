"""A word-level FM-index in numpy: suffix order, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions of a run keep their place, besides each run's first.
SAMPLE_EVERY = 16


class Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, largest: int):
        self.depth = max(1, int(largest).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        rest = symbols
        for level in range(self.depth):
            bit = (rest >> (self.depth - 1 - level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            rest = np.concatenate([rest[~bit], rest[bit]])
        every = np.arange(largest + 1)
        self.start = self._down(every, np.zeros(largest + 1, np.int64))

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbols >> (self.depth - 1 - level) & 1).astype(bool)
            ones = bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position i."""
        return self._down(symbols, i) - self.start[symbols]

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at positions i and their ranks there."""
        symbols = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.get(i), bits.rank(i)
            symbols = symbols << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return symbols, i - self.start[symbols]


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each 0 is an end of its own, and seq ends with 0."""
    ends = seq == 0
    first = np.where(ends, np.cumsum(ends) - 1, seq.astype(np.int64) + int(ends.sum()))
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(seq), np.int64)

    def settle(slots: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Gives rows in key order their ranks; returns which of them share theirs."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        heads = slots[np.flatnonzero(new)]
        rank[rows] = heads[np.cumsum(new) - 1]
        return ~(new & np.append(new[1:], True))

    open_slots = np.arange(len(seq))
    open_slots = open_slots[settle(open_slots, order, first[order])]
    k = 1
    while len(open_slots):
        rows = order[open_slots]
        keys = rank[rows] * len(seq) + rank[rows + k]
        by = np.argsort(keys, kind="stable")
        order[open_slots] = rows[by]
        open_slots = open_slots[settle(open_slots, rows[by], keys[by])]
        k *= 2
    return order


class FMIndex:
    """Index of runs of positive word ids, each run closed by a 0."""

    def __init__(self, seq: np.ndarray, largest: int):
        order = suffix_order(seq)
        self.n = len(seq)
        self.tree = WaveletMatrix(seq[order - 1].astype(np.int64), largest)
        counts = np.bincount(seq, minlength=largest + 1)
        self.below = np.cumsum(counts) - counts
        head = np.ones(self.n, bool)
        head[1:] = seq[:-1] == 0
        kept = head | (np.arange(self.n) % SAMPLE_EVERY == 0)
        self.sampled = Bits(kept[order])
        self.places = order[kept[order]]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length, [phrases, words]; backward search for all in step."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for column in phrases.T[::-1]:
            lo = self.below[column] + self.tree.rank(column, lo)
            hi = self.below[column] + self.tree.rank(column, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows, by steps back to the nearest sampled position."""
        out = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            known = self.sampled.get(rows)
            out[left[known]] = self.places[self.sampled.rank(rows[known])] + steps
            left, rows = left[~known], rows[~known]
            symbols, ranks = self.tree.read(rows)
            rows = self.below[symbols] + ranks
            steps += 1
        return out
