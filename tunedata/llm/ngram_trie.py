"""An n-gram trie in Elias-Fano form: monotone pointers, successors found relative to their context,
and quantised log probabilities, all in one anonymous memory map."""

from __future__ import annotations

import mmap

import numpy as np

#: Size of the codebook that probabilities are quantised to.
CODES = 1 << 12
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of n integers below u, in about 2 + log2(u / n) bits each.

    The low bits are packed as they are; the high parts are a bit vector that has a one for each
    value and a zero behind each high part, with a counter of ones for each 64 bits."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n = n
        self.bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = (values & np.uint64((1 << self.bits) - 1)).astype(np.uint64)
        self.low = self._pack(low, self.bits)
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        self.top = int(universe >> self.bits) + 1
        flags = np.zeros(-(-(n + self.top + 1) // 64) * 64, np.uint8)
        flags[high + np.arange(n)] = 1
        self.words = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = _POP[self.words.view(np.uint8).reshape(-1, 8)].sum(axis=1, dtype=np.int64)
        self.zeros = (np.arange(1, len(ones) + 1) * 64 - np.cumsum(ones)).astype(np.uint32 if len(flags) < 1 << 32 else np.uint64)

    @staticmethod
    def _pack(low: np.ndarray, bits: int) -> np.ndarray:
        if not bits:
            return np.zeros(1, np.uint64)
        at = np.arange(len(low), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = np.zeros(int(len(low) * bits // 64) + 2, np.uint64)
        np.bitwise_or.at(out, word, low << shift)
        spill = shift + np.uint64(bits) > np.uint64(64)
        np.bitwise_or.at(out, word[spill] + 1, low[spill] >> (np.uint64(64) - shift[spill]))
        return out

    def low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        spill = shift + np.uint64(self.bits) > np.uint64(64)
        out[spill] |= self.low[word[spill] + 1] << (np.uint64(64) - shift[spill])
        return out & np.uint64((1 << self.bits) - 1)

    def _ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        """Number of ones in front of the k-th zero (from 0): the index of the first value beyond."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right")
        left = k - np.where(word > 0, self.zeros[np.maximum(word - 1, 0)], 0).astype(np.int64)
        at = word * 64
        rest = ~self.words[word]
        for width in (32, 16, 8, 4, 2, 1):  # halve the word towards the zero that is looked for
            part = rest & np.uint64((1 << width) - 1)
            count = _POP[np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8)].sum(axis=1, dtype=np.int64)
            beyond = left >= count
            left = np.where(beyond, left - count, left)
            at = np.where(beyond, at + width, at)
            rest = np.where(beyond, rest >> np.uint64(width), part)
        return at - k

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value by successor search, or -1."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        want = values & np.uint64((1 << self.bits) - 1)
        begin = np.where(high > 0, self._ones_before_zero(np.maximum(high - 1, 0)), 0)
        end = self._ones_before_zero(high)
        todo = np.flatnonzero(begin < end)
        lo, hi = begin[todo], end[todo]
        while len(todo):  # binary search among the low bits of one high part
            mid = (lo + hi) >> 1
            low = self.low_at(mid)
            same = low == want[todo]
            out[todo[same]] = mid[same]
            right = low < want[todo]
            lo, hi = np.where(right, mid + 1, lo), np.where(right, hi, mid)
            go = ~same & (lo < hi)
            todo, lo, hi = todo[go], lo[go], hi[go]
        return out

    def arrays(self) -> list[str]:
        return ["low", "words", "zeros"]


class NgramTrie:
    """Two levels: contexts, and the successors of each. A successor is stored relative to its
    context: context index times vocabulary size plus word index, which is monotone over the level
    and makes the pointers between the levels implicit in it."""

    def __init__(self, contexts: np.ndarray, successors: np.ndarray, logs: np.ndarray, n_contexts: int, n_words: int):
        self.n_words = max(n_words, 1)
        self.level = EliasFano(contexts.astype(np.uint64) * np.uint64(self.n_words) + successors.astype(np.uint64),
                               max(n_contexts, 1) * self.n_words)
        self.codebook, self.codes = _quantise(logs)
        self._map()

    def _map(self) -> None:
        held = [(self.level, k) for k in self.level.arrays()] + [(self, "codes"), (self, "codebook")]
        sizes = [-(-getattr(o, k).nbytes // 8) * 8 for o, k in held]
        self.memory = mmap.mmap(-1, max(sum(sizes), 8))
        at = 0
        for (o, k), size in zip(held, sizes):
            a = getattr(o, k)
            view = np.frombuffer(self.memory, a.dtype, len(a), at)
            view[:] = a
            setattr(o, k, view)
            at += size

    def lookup(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log probability of each (context, word), nan where the pair has no node."""
        at = self.level.find(contexts.astype(np.uint64) * np.uint64(self.n_words) + words.astype(np.uint64))
        out = np.full(len(at), np.nan)
        hit = at >= 0
        out[hit] = self.codebook[self.codes[at[hit]]]
        return out


def _quantise(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A codebook of at most CODES values and the code of each: exact where values are few, else
    the means of equally full bins."""
    values, inverse, counts = np.unique(logs, return_inverse=True, return_counts=True)
    if len(values) <= CODES:
        return values if len(values) else np.zeros(1), inverse.astype(np.uint16)
    bins = np.minimum((np.cumsum(counts) - counts) * CODES // len(logs), CODES - 1)
    weight = np.bincount(bins, counts, CODES)
    book = np.bincount(bins, counts * values, CODES) / np.maximum(weight, 1)
    return book, bins[inverse].astype(np.uint16)
