"""Elias-Fano sequences and an n-gram trie level over them, in numpy on memory-mapped files.

``n`` sorted numbers below ``u`` take about ``2 + log2(u / n)`` bits each: the low bits
stand packed one after another, the high parts are written in unary, one set bit per
number and one clear bit per step of the high part.
"""

from __future__ import annotations

import os

import numpy as np

_BYTE_ZEROS = 8 - np.bitwise_count(np.arange(256, dtype=np.uint8))
#: Place of the r-th clear bit of a byte (8 where there is none), lowest bit first.
_SELECT_ZERO = np.array(
    [[(lambda at: at[r] if r < len(at) else 8)([i for i in range(8) if not b >> i & 1]) for r in range(8)] for b in range(256)],
    np.uint8,
)


def _select(data: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """In each 64-bit word the place of the clear bit of this rank."""
    octets = np.ascontiguousarray(data).view(np.uint8).reshape(-1, 8)
    before = np.cumsum(_BYTE_ZEROS[octets], axis=1, dtype=np.uint8)
    rest = rest.astype(np.uint8)
    byte = (before <= rest[:, None]).sum(axis=1)
    row = np.arange(len(rest))
    rest = rest - np.where(byte > 0, before[row, np.maximum(byte - 1, 0)], np.uint8(0))
    return byte * 8 + _SELECT_ZERO[octets[row, byte], rest]


def _stored(array: np.ndarray, folder: str | None, name: str) -> np.ndarray:
    """The array as a read-only memory map of a file, if a folder is given."""
    if folder is None or not array.size:
        return array
    path = os.path.join(folder, name)
    array.tofile(path)
    return np.memmap(path, array.dtype, "r", shape=array.shape)


class EliasFano:
    """A non-decreasing sequence of unsigned numbers."""

    def __init__(self, values: np.ndarray, folder: str | None = None, name: str = "sequence"):
        values = np.asarray(values, np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.width = width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(width)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        self.high = _stored(np.packbits(bits, bitorder="little").view(np.uint64), folder, name + ".high")
        zeros = 64 - np.bitwise_count(self.high).astype(np.int64)
        self.zeros = _stored(np.concatenate(([0], np.cumsum(zeros))), folder, name + ".rank")
        low = np.zeros(-(-n * width // 64) + 2, np.uint64)
        if width:
            part = values & np.uint64((1 << width) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            _or_at(low, word, part << shift)
            over = shift + np.uint64(width) > 64
            _or_at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        self.low = _stored(low, folder, name + ".low")
        self.last_high = int(high[-1]) if n else -1
        self.ones: np.ndarray | None = None  # set bits before each word, made when first asked for

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        above = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (value | above) & np.uint64((1 << self.width) - 1)

    def _select_zero(self, r: np.ndarray) -> np.ndarray:
        """Place of the r-th clear bit of the high part."""
        word = np.searchsorted(self.zeros, r, side="right") - 1
        return word * 64 + _select(self.high[word], r - self.zeros[word])

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the index of the first number that is not below it (n if none), and whether it equals x."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        h = (x >> np.uint64(self.width)).astype(np.int64)
        beyond = h > self.last_high
        h = np.minimum(h, self.last_high)
        # numbers with high part h follow the clear bit h - 1, one set bit each
        at = np.where(h > 0, self._select_zero(np.maximum(h - 1, 0)) + 1 - h, 0)
        low = x & np.uint64((1 << self.width) - 1)
        found = np.zeros(len(x), bool)
        going = np.flatnonzero(~beyond)
        for _ in range(4):
            bit = at[going] + h[going]
            there = (self.high[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            going = going[there]
            value = self._low(at[going])
            found[going[value == low[going]]] = True
            going = going[value < low[going]]
            at[going] += 1
        if len(going):  # where many numbers share a high part: by halves, up to the clear bit h
            first, end = at[going], self._select_zero(h[going]) - h[going]
            stop, wanted = end.copy(), low[going]
            while (open_ := first < stop).any():
                middle = (first + stop) // 2
                below = open_ & (self._low(np.minimum(middle, self.n - 1)) < wanted)
                first = np.where(below, middle + 1, first)
                stop = np.where(open_ & ~below, middle, stop)
            at[going] = first
            found[going] = (first < end) & (self._low(np.minimum(first, self.n - 1)) == wanted)
        return np.where(beyond, self.n, at), found

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these indexes."""
        i = np.asarray(i, np.int64)
        if self.ones is None:
            self.ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(self.ones, i, side="right") - 1
        rest = i - self.ones[word]
        place = word * 64 + _select(~self.high[word], rest)  # set bits as clear ones
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)


def _or_at(target: np.ndarray, index: np.ndarray, value: np.ndarray) -> None:
    """target[index] |= value with sorted, repeated indexes."""
    if len(index):
        starts = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        target[index[starts]] |= np.bitwise_or.reduceat(value, starts)


class TrieLevel:
    """Children of contexts: ``contexts`` (sorted), monotone ``pointers`` to their ranges, and the children's words,
    each written as an offset from the last number of the range before it, so that all are one rising sequence."""

    def __init__(self, parent: np.ndarray, word: np.ndarray, folder: str | None = None, name: str = "level"):
        """``parent``, ``word``: entries sorted by both, none twice."""
        n = len(parent)
        starts = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1]))) if n else np.zeros(0, np.int64)
        self.contexts = EliasFano(parent[starts], folder, name + ".context")
        self.pointers = EliasFano(np.append(starts, n), folder, name + ".pointer")
        own = word.astype(np.int64) + 1
        lengths = np.diff(np.append(starts, n))
        base = np.concatenate(([0], np.cumsum(own[starts + lengths - 1])[:-1])) if n else np.zeros(0, np.int64)
        self.words = EliasFano(own + np.repeat(base, lengths), folder, name + ".word")

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of each entry, -1 where there is none; entries are asked for in the order of their parents."""
        out = np.full(len(parent), -1, np.int64)
        new = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1]))) if len(parent) else np.zeros(0, np.int64)
        at, known = self.contexts.successor(parent[new])
        asked = np.flatnonzero(known)
        if not len(asked):
            return out
        first = self.pointers.get(at[asked]).astype(np.int64)
        end = self.pointers.get(at[asked] + 1).astype(np.int64)
        base = np.where(first > 0, self.words.get(np.maximum(first - 1, 0)).astype(np.int64), 0)
        count = np.diff(np.append(new, len(parent)))
        of_known = np.repeat(known, count)
        ask, times = np.flatnonzero(of_known), count[asked]
        place, equal = self.words.successor((np.repeat(base, times) + word[ask] + 1).astype(np.uint64))
        hit = equal & (place >= np.repeat(first, times)) & (place < np.repeat(end, times))
        out[ask[hit]] = place[hit]
        return out
