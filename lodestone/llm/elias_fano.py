"""Elias-Fano sequences of 64-bit numbers with access and successor search, as flat arrays."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each 64-bit word, by halving on counts."""
    at, k = np.zeros(len(word), np.uint64), k.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        part = (word >> at) & np.uint64((1 << half) - 1)
        n = np.bitwise_count(part).astype(np.int64)
        up = k >= n
        k = np.where(up, k - n, k)
        at = np.where(up, at + np.uint64(half), at)
    return at.astype(np.int64)


class EliasFano:
    """A rising sequence: the high parts in unary, the low parts in whole bytes.

    The unary bits hold a one for every element and a zero for every step of the high part. A
    count of zeros before each word is the directory by which a high part's elements, and the
    element at an index, are found.
    """

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bytes, self.low, self.high, self.zeros = n, low_bytes, low.reshape(n, low_bytes), high, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: rising uint64."""
        n = len(values)
        bits = int(values[-1]).bit_length() if n else 1
        low_bytes = max(0, min(7, (bits - max(n, 1).bit_length() + 7) // 8))
        shift = np.uint64(8 * low_bytes)
        low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :low_bytes].copy()
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        size = int(ones[-1]) + 2 if n else 2
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        return cls(n, low_bytes, low, high, zeros)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero; past the end for more than there are."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        inside = word < len(self.high)
        at = np.minimum(word, len(self.high) - 1)
        return np.where(inside, at * 64 + _select(~self.high[at], k - self.zeros[at]), len(self.high) * 64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(i), 8), np.uint8)
        wide[:, : self.low_bytes] = self.low[i]
        return wide.view("<u8").reshape(-1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The elements at indices below n."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, i, side="right") - 1
        place = word * 64 + _select(self.high[word], i - ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._low(i)

    def successor(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element >= q for each query, and whether it equals q."""
        if not self.n:
            return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        shift = np.uint64(8 * self.low_bytes)
        h = (q >> shift).astype(np.int64)
        # of high part h: the elements between the zero that opens it and the one that closes it
        lo = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - (h - 1), 0)
        hi = self._zero(h) - h
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        end, want = hi.copy(), q & ((_ONE << shift) - _ONE)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = open_ & (self._low(np.minimum(mid, self.n - 1)) < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, self.n - 1)
        return lo, (lo < end) & (self._low(at) == want)

    def arrays(self) -> list[np.ndarray]:
        return [self.low.reshape(-1), self.high, self.zeros]


class Level:
    """A trie's level: the children of each node of the level above, as ids that rise within their parent.

    An id is stored on top of the last stored id of the parent before, so that the whole level is
    one rising sequence whose size follows the ids' spread and not their number times 2 ** 40. A
    child is found relative to its context: the pointers (another rising sequence) give the
    parent's range and base, and a successor search gives the child's place.
    """

    def __init__(self, ids: EliasFano, pointers: EliasFano):
        self.ids, self.pointers = ids, pointers

    @classmethod
    def of(cls, parent: np.ndarray, ids: np.ndarray, n_parents: int) -> Level:
        """parent: rising numbers of the children's parents; ids: uint64, rising within a parent."""
        ends = np.cumsum(np.bincount(parent, minlength=n_parents))
        last = np.zeros(n_parents, np.uint64)
        full = np.diff(ends, prepend=0) > 0
        last[full] = ids[ends[full] - 1] + _ONE
        base = np.cumsum(last) - last
        return cls(EliasFano.of(ids + base[parent]), EliasFano.of(np.concatenate([[0], ends]).astype(np.uint64)))

    def ranges(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first child, end of the children, base of their ids) of each parent."""
        first, end = (self.pointers.at(parent + i).astype(np.int64) for i in (0, 1))
        base = self.ids.at(np.maximum(first - 1, 0)) + _ONE if self.ids.n else np.zeros(len(parent), np.uint64)
        return first, end, np.where(first > 0, base, np.uint64(0))

    def find(self, end: np.ndarray, base: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ids among the children that ranges gave, and whether they are there."""
        at, equal = self.ids.successor(base + ids)
        return at, equal & (at < end)

    def arrays(self) -> list[np.ndarray]:
        return [*self.ids.arrays(), *self.pointers.arrays()]
