"""Elias-Fano coding of a sorted set of integers with successor search, in NumPy.

``n`` distinct values below ``2**universe_bits`` take about ``n * (2 + low_bits)`` bits:
the low bits are packed, the high parts are a unary bit vector in which value ``i`` sets
bit ``high + i``. A directory of zero counts per 64-bit word (about two more bits a value)
answers select-zero queries, and thereby successor searches, without decoding the set.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def _low_bits(n: int, universe_bits: int) -> int:
    return max(0, universe_bits - max(1, n).bit_length()) if n else 0


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    if not bits or not len(values):
        return np.zeros(1, U64)
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(U64)
    out = np.zeros(int(at[-1] + bits + 63 >> 6) + 1, U64)

    def put(where: np.ndarray, what: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        out[where[starts]] |= np.bitwise_or.reduceat(what, starts)

    put(word, values << shift)
    over = shift + U64(bits) > U64(64)
    if over.any():
        put(word[over] + 1, values[over] >> (U64(64) - shift[over]))
    return out


def _unpack(packed: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(index), U64)
    at = index * bits
    word, shift = at >> 6, (at & 63).astype(U64)
    v = packed[word] >> shift
    back = U64(64) - shift
    high = np.where(shift > 0, packed[np.minimum(word + 1, len(packed) - 1)] << (back & U64(63)), U64(0))
    return (v | high) & U64((1 << bits) - 1)


class EliasFano:
    """A sorted set of distinct unsigned integers."""

    def __init__(self, n: int, universe_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe_bits, self.low, self.high = n, universe_bits, low, high
        self.low_bits = _low_bits(n, universe_bits)
        ones = np.bitwise_count(high).astype(np.int64)
        self.zeros = np.r_[0, np.cumsum(64 - ones)]  # zeros before each word

    @classmethod
    def encode(cls, values: np.ndarray, universe_bits: int) -> EliasFano:
        """``values``: sorted distinct integers below ``2**universe_bits``."""
        values = np.asarray(values, U64)
        n, low_bits = len(values), _low_bits(len(values), universe_bits)
        high = (values >> U64(low_bits)).astype(np.int64)
        size = n + (1 << (universe_bits - low_bits if n else 0)) + 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(U64)
        return cls(n, universe_bits, _pack(values & U64((1 << low_bits) - 1), low_bits), words)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        index = np.arange(self.n)
        return ((ones - index).astype(U64) << U64(self.low_bits)) | _unpack(self.low, index, self.low_bits)

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the zero number ``k`` (from 0) of the unary part."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        rest = (k - self.zeros[word])[:, None]
        zero = 1 - np.unpackbits(self.high[word][:, None].view(np.uint8), axis=1, bitorder="little").astype(np.int16)
        return word * 64 + np.argmax(np.cumsum(zero, axis=1) > rest, axis=1)

    def successor(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and value of the smallest member >= each probe; index ``n`` where there is none."""
        probes = np.asarray(probes, U64)
        index, value = np.full(len(probes), self.n, np.int64), np.zeros(len(probes), U64)
        for a in range(0, len(probes) if self.n else 0, 1 << 16):
            p = probes[a : a + (1 << 16)]
            h = (p >> U64(self.low_bits)).astype(np.int64)
            first = np.where(h > 0, self._select_zero(np.maximum(h - 1, 0)) - (h - 1), 0)
            after = self._select_zero(h) - h  # members with a high part up to that of the probe
            want, at = p & U64((1 << self.low_bits) - 1), first.copy()
            open_ = np.flatnonzero(at < after)
            while len(open_):
                less = _unpack(self.low, at[open_], self.low_bits) < want[open_]
                open_ = open_[less]
                at[open_] += 1
                open_ = open_[at[open_] < after[open_]]
            index[a : a + len(p)] = at
            inside = (at < after).nonzero()[0]  # found below the same high part
            value[a + inside] = ((h[inside].astype(U64)) << U64(self.low_bits)) | _unpack(self.low, at[inside], self.low_bits)
            later = ((at >= after) & (at < self.n)).nonzero()[0]
            value[a + later] = self._at(at[later])
        return index, value

    def _at(self, index: np.ndarray) -> np.ndarray:
        """Members by index, by select-one over the unary part."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, index, side="right") - 1
        rest = (index - ones[word])[:, None]
        bits = np.unpackbits(self.high[word][:, None].view(np.uint8), axis=1, bitorder="little").astype(np.int16)
        at = word * 64 + np.argmax(np.cumsum(bits, axis=1) > rest, axis=1)
        return ((at - index).astype(U64) << U64(self.low_bits)) | _unpack(self.low, index, self.low_bits)

    def contains(self, probes: np.ndarray) -> np.ndarray:
        index, value = self.successor(probes)
        return (index < self.n) & (value == np.asarray(probes, U64))

    def merge(self, new: np.ndarray) -> EliasFano:
        """With the sorted distinct values ``new``, none of which is a member yet."""
        old, new = self.decode(), np.asarray(new, U64)
        out = np.empty(len(old) + len(new), U64)
        at = np.searchsorted(old, new) + np.arange(len(new))
        keep = np.ones(len(out), bool)
        keep[at] = False
        out[at], out[keep] = new, old
        return EliasFano.encode(out, self.universe_bits)

    def size_bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes

    def to_bytes(self) -> tuple[int, bytes, bytes]:
        return self.n, self.low.tobytes(), self.high.tobytes()

    @classmethod
    def from_bytes(cls, n: int, universe_bits: int, low: bytes, high: bytes) -> EliasFano:
        return cls(n, universe_bits, np.frombuffer(low, U64), np.frombuffer(high, U64))
