"""Wavelet matrix: a sequence of symbols as succinct bit planes with rank and select.

Level by level, from the highest bit down, a plane holds that bit of every symbol and the symbols are dealt stably by it,
zeros first. Rank on a plane is one directory entry and one popcount; counting, access and occurrence lookup of symbols
go down (and select up again) through the planes. All calls take NumPy arrays of positions or symbols.
"""

from __future__ import annotations

import struct

import numpy as np

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


class Plane:
    """Bits with a running count of ones before each 64-bit word."""

    __slots__ = ("ones", "size", "words", "zeros")

    def __init__(self, packed: np.ndarray, size: int):
        self.size = size
        padded = np.zeros((size >> 6) * 8 + 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.ones = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.ones[1:])
        self.zeros = size - int(self.ones[-1])

    def rank1(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.ones[word] + np.bitwise_count(self.words[word] & ~(_ONES << bit))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.size, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def select(self, nth: np.ndarray, bit: bool) -> np.ndarray:
        """Place of the nth (from 0) one or zero."""
        counts = self.ones if bit else (np.arange(len(self.ones)) << 6) - self.ones
        word = np.searchsorted(counts, nth, "right") - 1
        inside = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if not bit:
            inside = 1 - inside
        return (word << 6) + (np.cumsum(inside, axis=1) > (nth - counts[word])[:, None]).argmax(axis=1)


class WaveletMatrix:
    def __init__(self, planes: list[Plane], size: int):
        self.planes, self.size, self.depth = planes, size, len(planes)

    @classmethod
    def build(cls, symbols: np.ndarray, depth: int) -> WaveletMatrix:
        """``symbols``: unsigned integers below ``2**depth``."""
        planes, left = [], symbols
        for level in reversed(range(depth)):
            bit = (left & left.dtype.type(1 << level)) != 0
            planes.append(Plane(np.packbits(bit, bitorder="little"), len(left)))
            if level:
                left = np.concatenate([left.take(np.flatnonzero(~bit)), left.take(np.flatnonzero(bit))])
        return cls(planes, len(symbols))

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for plane in self.planes:
            bit, ones = plane.get(at), plane.rank1(at)
            at = np.where(bit, plane.zeros + ones, at - ones)
            out = (out << 1) | bit
        return out

    def decode(self) -> np.ndarray:
        """The whole sequence, rebuilt from the lowest plane up."""
        dtype = np.uint16 if self.depth <= 16 else np.uint32
        out = np.zeros(self.size, dtype)
        for level, plane in enumerate(reversed(self.planes)):
            bit, dealt = plane.bits(), out
            out = np.empty_like(dealt)
            out[np.flatnonzero(~bit)] = dealt[: plane.zeros]
            out[np.flatnonzero(bit)] = dealt[plane.zeros :] | dtype(1 << level)
        return out

    def bounds(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbol's occurrences in [low, high) lie in the order below the last plane."""
        low, high = np.asarray(low, np.int64), np.asarray(high, np.int64)
        for level, plane in zip(reversed(range(self.depth)), self.planes, strict=True):
            bit = (symbols >> level) & 1 != 0
            a, b = plane.rank1(low), plane.rank1(high)
            low, high = np.where(bit, plane.zeros + a, low - a), np.where(bit, plane.zeros + b, high - b)
        return low, high

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        symbols = np.asarray(symbols, np.int64)
        low, high = self.bounds(symbols, np.zeros(len(symbols), np.int64), at)
        return high - low

    def count(self, symbol: int) -> int:
        return int(self.rank(np.array([symbol]), np.array([self.size]))[0])

    def select(self, symbol: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the nth (from 0) occurrences of a symbol."""
        low, _ = self.bounds(np.array([symbol]), np.zeros(1, np.int64), np.array([self.size]))
        at = low[0] + np.asarray(nth, np.int64)
        for level, plane in enumerate(reversed(self.planes)):
            at = plane.select(at - plane.zeros, True) if symbol >> level & 1 else plane.select(at, False)
        return at

    def occurrences(self, symbol: int) -> np.ndarray:
        return self.select(symbol, np.arange(self.count(symbol)))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QI", self.size, self.depth)
        return head + b"".join(p.words.tobytes() for p in self.planes)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        size, depth = struct.unpack_from("<QI", data)
        step = (size >> 6) * 8 + 8
        return cls([Plane(np.frombuffer(data, np.uint8, step, 12 + i * step), size) for i in range(depth)], size)
