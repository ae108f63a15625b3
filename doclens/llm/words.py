"""Words of Arrow text columns as NumPy arrays.

A text column arrives in a task as one byte buffer with row offsets. Words are maximal runs of word bytes inside one
row; each gets a 64-bit hash, computed for the whole buffer at once, so no Python object is made for a word. UTF-8 keeps
every byte of a non-ASCII character at 0x80 or above, so classes of bytes stand for the classes of characters used here.

A hash is the sum of a random number for each place and byte, from a fixed table for the first places and by a mixing
function beyond. Two strings that differ anywhere have sums that differ by independent random numbers, so that their
hashes are equal with a chance of 2**-64, whatever structure the strings have. (A polynomial modulo 2**64 would give equal hashes
to certain long words for every base.)
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(7)
#: Places of a string that the table has random numbers for.
_NEAR = 64
_TABLE = _RANDOM.integers(0, 2**64, (_NEAR, 256), np.uint64)
_FACTORS = _RANDOM.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: Random numbers of a byte, A-Z lower-cased, at each of the first places.
PLACES = _TABLE[:, _LOWER]
#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: All bytes.
EVERY = np.ones(256, bool)

#: The words ALNUM by bytes.translate() and split(), for one text at a time.
ALNUM_TRANSLATION = bytes(_LOWER[b] if ALNUM[b] else 0x20 for b in range(256))


def _numbers(is_word: np.ndarray, lower: bool) -> np.ndarray:
    """The table with A-Z lower-cased, and 0 for bytes outside words."""
    return np.where(is_word, _TABLE[:, _LOWER] if lower else _TABLE, np.uint64(0)).ravel()


_TABLES = {NOT_SPACE.tobytes(): _numbers(NOT_SPACE, True), ALNUM.tobytes(): _numbers(ALNUM, True), EVERY.tobytes(): _numbers(EVERY, False)}


class Words(NamedTuple):
    """Words of several rows, in order."""

    start: np.ndarray
    """First byte of each word in the buffer."""
    end: np.ndarray
    """Byte after each word."""
    first: np.ndarray
    """For each row the number of its first word; one more entry at the end."""
    hash: np.ndarray
    """64-bit hash of each word."""

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input sways every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary or string column (null: empty) and the offsets of its rows in them."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Hand freed memory back to the system: a Python worker serves one task after another, and its allocators keep what the largest of
    them needed."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over batches that leaves no freed memory behind in the worker."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return passed


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows with about ``most`` bytes of text; a longer row is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """Hash of each string data[start:end]; strings do not overlap and stand in order, and bytes between them are not of ``is_word``.
    A-Z are lower-cased but for EVERY."""
    if not len(start):
        return np.zeros(0, np.uint64)
    table = _TABLES[is_word.tobytes()]
    place = np.zeros(len(data), np.int32)
    place[start] = start
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(data), dtype=np.int32), place, out=place)
    far = np.flatnonzero((place >= _NEAR) & is_word[data]) if int((end - start).max()) > _NEAR else ()
    beyond = place[far] if len(far) else None
    np.minimum(place, _NEAR - 1, out=place)
    place <<= 8
    place |= data
    numbers = table.take(place)
    if beyond is not None:
        numbers[far] = mixed(numbers[far] ^ mixed(beyond.astype(np.uint64) * np.uint64(_ODD)))
    return mixed(np.add.reduceat(numbers, start))


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Words of the rows that ``offsets`` cut ``data`` into."""
    n = len(data)
    inside = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    joined = np.zeros(n + 1, bool)  # byte i goes on with the word of byte i - 1
    if n:
        joined[1:n] = inside[1:] & inside[:-1] & ~cut[1:n]
    start = np.flatnonzero(inside & ~joined[:n])
    end = np.flatnonzero(inside & ~joined[1:]) + 1
    return Words(start, end, np.searchsorted(start, offsets), hashes_of(data, start, end, is_word))


def words_in(column: pa.Array, is_word: np.ndarray) -> Words:
    return words_of(*text_bytes(column), is_word)


def spans_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words that begins at word 0, 1, ...; row limits are the caller's to heed. Each place has a random
    factor of its own."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        total += hashes[i : len(hashes) - n + 1 + i] * _FACTORS[i]
    return mixed(total)
