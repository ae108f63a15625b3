"""Token-ID output: documents as token ids in wavelet-matrix shards.

Documents are range-partitioned and sorted, by doc_id or by a given order. A task encodes its stretch with the given tokenizer file,
ends each document with ``END`` and cuts shards of about ``SHARD_TOKENS`` ids at document ends. A shard is one compressed blob: the
document ids and lengths, and the ids as the succinct bit planes of a wavelet matrix, which support token access,
counting and occurrence lookup without another copy of the sequence. A reader unpacks a shard as a whole, as each of these goes
through all planes. Shards are rows of a Parquet table (Spark's commit
protocol and file systems), so a lost executor costs its own shards only. Only one row for each partition reaches the driver, to
number the ids across partitions.

Encoding is the tokenizer library's. Byte-level BPE of this kind splits a text at certain places whatever else it holds
(before white space after other characters, before a punctuation mark after a letter, around a line feed that ends white space), so the
text is cut there and each distinct piece is encoded once; its bytes and ids are kept in a bounded cache of the Python worker. New pieces that are cut
from each other when set side by side go to the library as one text, and the bytes of its ids tell whose they are. Pieces are
found by a 64-bit hash and compared byte by byte; should two pieces share a hash, the library encodes those texts as a whole.

Cases: a null or empty text is the end id alone; a null doc_id sorts first; repeated doc_ids stand side by side, by text;
a text without spaces is one piece; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.wavelet import WaveletMatrix
from doclens.llm.words import ALNUM, EVERY, hashes_of, pieces, released, text_bytes

END = 2
SHARD_TOKENS = 2 << 20
#: Distinct pieces that a worker keeps (some 35 bytes each); beyond that it starts anew.
CACHE_PIECES = 1_000_000
#: Pieces that the library encodes in one call.
LEARNED = 512
#: Bytes of text that are encoded at a time.
STRETCH = 1 << 19
STORE = "part int, seq int, before long, n_docs int, n_tokens long, data binary"


class Encoder:
    """Ids of texts, with those of pieces kept for reuse."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.int32
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {n: len(t.content.encode()) for n, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: Bytes that each id stands for: a character of a byte-level token is a byte.
        self.sizes = np.zeros(max([*vocabulary.values(), *added]) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.sizes[list(added)] = list(added.values())
        self.forget()

    def forget(self) -> None:
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and which piece each is of
        self.ids, self.bytes = Growing(self.dtype), Growing(np.uint8)

    def learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Keep the pieces ``data[start:end]``, whose hashes are ``keys`` in order."""
        kind = joint(data, start, end)
        order = np.argsort(kind, kind="stable")
        number = np.empty(len(keys), np.int32)
        number[order] = len(self.keys) + np.arange(len(keys), dtype=np.int32)
        for this in (SPACED, WORDED, ALONE):
            rows = order[kind[order] == this]
            for low in range(0, len(rows), LEARNED):  # the library's results are far larger than the ids, so a few are held at a time
                some = rows[low : low + LEARNED]
                size = end[some] - start[some]
                text = data.take(np.arange(int(size.sum())) + np.repeat(start[some] - (np.cumsum(size) - size), size))
                ids, counts = (self.encode_joined(text, size, int(this == WORDED)) if this != ALONE else None) or self.encode_alone(text, size)
                self.ids.add(ids, counts)
                self.bytes.add(text, size)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.number = np.insert(self.keys, at, keys), np.insert(self.number, at, number)

    def encode_joined(self, text: np.ndarray, size: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces as one text, with ``gap`` line feeds between, told apart by the bytes that each id stands for; None where a piece's
        ends are no ends of ids, as then its ids are others."""
        ends = np.cumsum(size + gap) - gap
        starts = ends - size
        if gap:
            whole = np.full(int(ends[-1]), 0x0A, np.uint8)
            whole[np.arange(len(text)) + np.repeat(gap * np.arange(len(size)), size)] = text
        else:
            whole = text
        ids = np.array(self.tokenizer.encode_batch_fast([whole.tobytes().decode()], add_special_tokens=False)[0].ids, np.int64)
        places = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        low, high = (np.minimum(np.searchsorted(places, x), len(places) - 1) for x in (starts, ends))
        if places[-1] != len(whole) or (places[low] != starts).any() or (places[high] != ends).any():
            return None
        counts = high - low
        return ids.take(np.arange(int(counts.sum())) + np.repeat(low - (np.cumsum(counts) - counts), counts)).astype(self.dtype), counts

    def encode_alone(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, each a text of its own."""
        raw, ends = text.tobytes(), np.cumsum(size)
        ids = [e.ids for e in self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.dtype), np.array([len(x) for x in ids], np.int64)

    def uncut(self, raw: bytes, offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Texts that hold a special token's string stay whole: the library looks for it before it splits."""
        rows = set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, at + 1)
        for row in rows:
            start = start[(start <= offsets[row]) | (start >= offsets[row + 1])]
        return start

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, each ended by END, and how many each has."""
        data, offsets = text_bytes(column)
        raw = data.tobytes()
        start = self.uncut(raw, offsets, piece_starts(data, offsets))
        end = np.append(start[1:], len(data))
        keys = hashes_of(data, start, end, EVERY)
        distinct, first, which = distinct_of(keys)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            if len(self.keys) + len(new) > CACHE_PIECES:
                self.forget()
                new = np.arange(len(distinct))
            self.learn(distinct[new], data, start[first[new]], end[first[new]])
        piece = self.number[np.searchsorted(self.keys, distinct)][which]
        length = end - start
        kept = self.bytes.first[piece]
        if (self.bytes.first[piece + 1] - kept != length).any() or (self.bytes.data.take(np.arange(len(data)) + np.repeat(kept - start, length)) != data).any():
            return self.encode_whole(raw, offsets)
        begin = self.ids.first[piece]
        size = self.ids.first[piece + 1] - begin
        counts = np.diff(np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, offsets)]) + 1
        ends = np.cumsum(counts) - 1
        out = np.empty(int(counts.sum()), self.dtype)
        body = np.ones(len(out), bool)
        body[ends] = False
        shift = begin - (np.cumsum(size) - size)
        out[body] = self.ids.data.take(np.arange(int(size.sum())) + np.repeat(shift, size))
        out[ends] = END
        return out, counts

    def encode_whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library alone, a text at a time."""
        ids = [[*self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, END] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.fromiter(chain.from_iterable(ids), self.dtype), np.array([len(x) for x in ids], np.int64)


class Growing:
    """Strings of numbers end to end; string i is data[first[i]:first[i + 1]]."""

    def __init__(self, dtype) -> None:
        self.data, self.first, self.n = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), 0

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        low, high = int(self.first[self.n]), int(self.first[self.n]) + len(data)
        if high > len(self.data):
            self.data = np.concatenate([self.data[:low], np.zeros(max(len(data), low // 4), self.data.dtype)])
        self.data[low:high] = data
        if self.n + len(sizes) >= len(self.first):
            self.first = np.concatenate([self.first[: self.n + 1], np.zeros(max(len(sizes), self.n // 4), np.int64)])
        self.first[self.n + 1 : self.n + 1 + len(sizes)] = low + np.cumsum(sizes)
        self.n += len(sizes)


def distinct_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and for each key which it is: ``np.unique``, but only distinct keys are sorted."""
    coded = pa.array(keys).dictionary_encode()
    found, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.argsort(found)
    place, at = np.empty(len(order), np.int32), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order), dtype=np.int32)
    at[code] = np.arange(len(code))
    return found[order], at[order], place.take(code)


_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, (0x20, *range(0x09, 0x0E)))
_MARK = (_BYTE > 0x20) & (_BYTE < 0x7F) & ~ALNUM
_PLAIN = (_BYTE > 0x20) & (_BYTE < 0x7F)
#: Classes of a byte as bits: white space, mark, letter or digit (the latter two are plain), C3, and what may end a letter after C3.
_CLASSES = (_SPACE * 1 + _MARK * 2 + (ALNUM & (_BYTE < 0x80)) * 4 + (_BYTE == 0xC3) * 8 + ((_BYTE >= 0x80) & (_BYTE != 0x97) & (_BYTE != 0xB7)) * 16).astype(np.uint8).tobytes()


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text; at white space after a byte known to be of none; at a punctuation mark after a letter
    or digit; before and after a line feed that a byte known to be of no white space follows, as ``\\s+(?!\\S)|\\s+`` leaves the last
    white space before a word to itself. Known are ASCII and the letters that begin with byte C3, so that no cut depends on tables of
    Unicode."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        kind = np.frombuffer(data.tobytes().translate(_CLASSES), np.uint8)
        before, here = kind[:-1], kind[1:]
        latin = np.zeros(n - 1, bool)  # the byte before ends a letter such as e with an accent
        latin[1:] = ((kind[:-2] & 8) != 0) & ((before[1:] & 16) != 0)
        letter = ((before & 4) != 0) | latin
        cut[1:n] = (((here & 1) != 0) & (((before & 6) != 0) | latin)) | (((here & 2) != 0) & letter)
        last = (data[:-1] == 0x0A) & ((here & 14) != 0)
        inner = offsets[(offsets > 0) & (offsets < n)]
        last[inner - 1] = False  # the byte that follows is another text's
        cut[1:n] |= last
        cut[: n - 1] |= last
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut[:n])


#: How a piece may stand beside others in one text.
SPACED, WORDED, ALONE = range(3)


def joint(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each piece ``data[start:end]``, by the cuts of ``piece_starts``: SPACED pieces begin with white space and end with a byte known to be of none,
    so they are cut where one follows another; WORDED ones begin with such a byte, so a line feed before it is cut off on both sides."""
    opens, closes = data[start], data[end - 1]
    latin = (end - start > 1) & (data[np.maximum(end - 2, 0)] == 0xC3) & (closes >= 0x80) & (closes != 0x97) & (closes != 0xB7)
    return np.where(_SPACE[opens] & (_PLAIN[closes] | latin), SPACED, np.where(_PLAIN[opens] | (opens == 0xC3), WORDED, ALONE))


class TokenShard:
    """One shard, read from its blob."""

    def __init__(self, data: bytes):
        n_docs, n_ids = struct.unpack_from("<II", data)
        self.doc_ids = np.frombuffer(data, np.int64, n_docs, 8)
        self.has_id = np.frombuffer(data, np.uint8, n_docs, 8 + 8 * n_docs).astype(bool)
        self.lengths = np.frombuffer(data, np.int64, n_docs, 8 + 9 * n_docs)
        at = 8 + 17 * n_docs
        self.tree = WaveletMatrix.from_bytes(pa.decompress(data[at:], n_ids, "zstd", asbytes=True))
        self.ends = np.cumsum(self.lengths)

    @staticmethod
    def pack(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        tree = WaveletMatrix.build(ids.astype(np.uint16 if depth <= 16 else np.uint32, copy=False), depth).to_bytes()
        numbers = np.asarray(doc_ids.fill_null(0)).astype(np.int64)
        head = struct.pack("<II", len(doc_ids), len(tree)) + numbers.tobytes() + np.asarray(doc_ids.is_valid()).astype(np.uint8).tobytes()
        return head + lengths.astype(np.int64).tobytes() + pa.compress(tree, "zstd", asbytes=True)

    def tokens(self, doc: int) -> np.ndarray:
        """Ids of the nth document."""
        return self.tree.access(np.arange(self.ends[doc] - self.lengths[doc], self.ends[doc]))

    def count(self, token: int) -> int:
        return self.tree.count(token)

    def occurrences(self, token: int) -> list[tuple[int, int]]:
        """Document of the shard and place in it, of every occurrence."""
        at = self.tree.occurrences(token)
        doc = np.searchsorted(self.ends, at, "right")
        return list(zip(doc.tolist(), (at - (self.ends - self.lengths)[doc]).tolist(), strict=True))


#: Encoders of this Python worker, which serves one task after another.
_encoders: dict[str, Encoder] = {}


def write(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS, order: list[Column] | None = None) -> None:
    """Write the store of ``docs`` (doc_id, text) to ``path``, in ascending order of doc_id or of the columns ``order``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, lengths, docs_ = [], [], []

        def shard() -> pa.RecordBatch:
            nonlocal seq, before
            tokens, sizes = np.concatenate(ids), np.concatenate(lengths)
            blob = TokenShard.pack(pa.concat_arrays(docs_), sizes, tokens)
            row = [[part], [seq], [before], [len(sizes)], [len(tokens)], [blob]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            seq, before = seq + 1, before + len(tokens)
            ids.clear(), lengths.clear(), docs_.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "seq", "before", "n_docs", "n_tokens", "data"])

        for piece in pieces(batches, "text", STRETCH):
            tokens, counts = encoder.encode(piece.column("text"))
            ids.append(tokens)
            lengths.append(counts)
            docs_.append(piece.column("doc_id").cast(pa.int64()))
            if sum(map(len, ids)) >= shard_tokens:
                yield shard()
        if ids:
            yield shard()

    places = [c.alias(f"place{i}") for i, c in enumerate(order or [F.col("doc_id")])]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *places)
    names = [f"place{i}" for i in range(len(places))]
    rows = rows.repartitionByRange(*names).sortWithinPartitions(*names, "doc_id", "text").select("doc_id", "text")
    rows.mapInArrow(released(packed), STORE).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of a store: doc_id, start, n_tokens, ids_crc32, in no set order of rows."""
    store = spark.read.schema(STORE).parquet(path)
    totals = {r.part: r.n for r in store.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n")).collect()}
    first, seen = {}, 0
    for part in sorted(totals):
        first[part], seen = seen, seen + totals[part]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, blob in zip(batch["part"].to_pylist(), batch["before"].to_pylist(), batch["data"], strict=True):
                shard = TokenShard(blob.as_buffer().to_pybytes())
                ids = memoryview(shard.tree.decode().astype("<u4")).cast("B")
                start = shard.ends - shard.lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(start.tolist(), shard.ends.tolist(), strict=True)]
                doc_ids = pa.array(shard.doc_ids, mask=~shard.has_id)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + before + first[part]), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.select("part", "before", "data").mapInArrow(released(unpacked), "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """How often each given token occurs in the store, by rank in each shard."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch["data"]:
                shard = TokenShard(blob.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int32()), pa.array([shard.count(t) if t >> shard.tree.depth == 0 else 0 for t in tokens], pa.int64())], ["token", "n"])

    rows = spark.read.schema(STORE).parquet(path).select("data").mapInArrow(released(counted), "token int, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))
