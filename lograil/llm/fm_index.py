"""An FM-index of word sequences: suffix order, BWT in a wavelet matrix of packed bits, backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(8 + -len(packed) % 8), np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.ones = int(self.before[-1])
        self.zeros = n - self.ones

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class FMIndex:
    """Index of sequences of symbols >= 1; each ends in a separator of its own, which no search meets."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, depth: int):
        """sequences: all symbols one after another; depth: the length at which rows are grouped."""
        ends = np.cumsum(lengths)
        count = len(lengths)
        n = len(sequences) + count
        text = np.zeros(n, np.int64)
        own = np.arange(len(sequences)) + np.repeat(np.arange(count), lengths)
        text[own] = sequences
        self.starts = ends - lengths + np.arange(count)  # of each sequence in text
        self.text = text
        # Prefix doubling. Separators rank below all symbols, each by its own number, so no comparison goes past one.
        rank = text + count
        stops = ends + np.arange(count)
        rank[stops] = np.arange(count)
        self.depth, ranks, size = depth, {}, 1
        order = np.argsort(rank, kind="stable")
        rank = self._dense(rank[order], order)
        while True:
            ranks[size] = rank
            if int(rank.max()) == n - 1 and size >= depth:
                break
            if int(rank.max()) == n - 1:
                size *= 2
                continue
            key = rank * np.int64(n + 1)
            key[: n - size] += rank[size:] + 1
            order = np.argsort(key, kind="stable")
            rank = self._dense(key[order], order)
            size *= 2
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        self.sa = sa
        # Rows whose suffixes agree in the first depth symbols: two overlapping powers of two.
        power = 1 << (depth.bit_length() - 1)
        half = ranks[power]
        a = half[sa]
        b = half[np.minimum(sa + depth - power, n - 1)]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        self.group = np.cumsum(new) - 1
        self.group_start = np.flatnonzero(new)
        self.group_end = np.concatenate((self.group_start[1:], [n]))
        # BWT, with all separators as symbol 0, level by level from the highest bit.
        bwt = text[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))))
        self.levels = []
        for bit in range(max(1, int(text.max(initial=0)).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones)))
            bwt = np.concatenate((bwt[~ones], bwt[ones]))

    @staticmethod
    def _dense(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(np.concatenate(([0], sorted_keys[1:] != sorted_keys[:-1])))
        return out

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of patterns become those of the patterns with symbol before them."""
        zero = np.zeros_like(lo)
        for bit, v in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            at = np.stack((lo, hi, zero))
            r = v.rank1(at)
            lo, hi, zero = np.where(one[None, :], v.zeros + r, at - r)
        base = self.first[symbol]
        return base + lo - zero, base + hi - zero

    def matches(self, sequences: list[np.ndarray]):
        """Streams sequences backwards; yields (numbers of sequences, offsets, lo, hi) for matches of depth symbols.

        These are matching statistics cut off at depth: when a match grows beyond it, the interval widens
        to the rows that share its first depth symbols.
        """
        lengths = np.array([len(s) for s in sequences])
        by = np.argsort(-lengths, kind="stable")
        live = len(by)
        padded = np.concatenate([*sequences, np.zeros(1, np.int64)]) if len(sequences) else np.zeros(1, np.int64)
        ends = np.cumsum(lengths)[by] if len(sequences) else np.zeros(0, np.int64)
        sizes = lengths[by]
        n = len(self.text)
        lo, hi, d = np.zeros(live, np.int64), np.full(live, n, np.int64), np.zeros(live, np.int64)
        for t in range(1, int(lengths.max(initial=0)) + 1):
            live = int(np.searchsorted(-sizes, -t, side="right"))  # sequences of t symbols or more
            lo, hi, d = lo[:live], hi[:live], d[:live]
            c = padded[ends[:live] - t]
            new_lo, new_hi = self.step(c, lo, hi)
            empty = new_lo >= new_hi
            if empty.any():  # only for sequences that are not in the index: the match begins anew
                new_lo, new_hi, d = np.where(empty, 0, new_lo), np.where(empty, n, new_hi), np.where(empty, -1, d)
            lo, hi, d = new_lo, new_hi, d + 1
            over = np.flatnonzero(d > self.depth)
            g = self.group[lo[over]]
            lo[over], hi[over], d[over] = self.group_start[g], self.group_end[g], self.depth
            full = np.flatnonzero(d == self.depth)
            if len(full):
                yield by[full], sizes[full] - t, lo[full], hi[full]
