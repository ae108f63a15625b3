"""Benchmark decontamination with an FM-index per training shard.

A phrase is 13 consecutive words of a benchmark item, or the whole item if it has fewer. A shard is a stretch of
documents of one task. Its words that no phrase holds cannot lie in an occurrence, so they only separate; what stays are
runs of phrase words, at least as long as the shortest phrase. Over the runs an FM-index is built: a suffix array by
prefix doubling, where each separator is a symbol of its own, so that sorting ends with the longest run, the
Burrows-Wheeler string in a wavelet matrix, and sampled suffix positions. All phrases are searched backwards at once;
occurrences are located by stepping to the next sample; overlapping ones merge into removal spans.

Every document lies in one shard, so nothing is shuffled. The benchmark is sent to the tasks in blocks of checked size,
each block a pass over the documents.

Cases: a null or empty text has no words and is clean; an item without words is no phrase; a null item_id is not
reported in ``item_ids`` though its phrases count as hits; repeated documents and items keep their own rows and ids;
an empty table of documents gives an empty result and an empty benchmark leaves all documents clean; other columns of
the input stay, whatever their names, but for those named like a result column, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.passes import TEXT, carried, map_rows, named
from doclens.llm.wavelet import WaveletMatrix
from doclens.llm.words import ALNUM, pieces, text_bytes, words_of
from doclens.session import materialise

WINDOW = 13
#: Contaminated: at least one in so many words is hit.
HIT_SHARE = 20
#: Bytes of benchmark text that one pass sends to every task.
BLOCK_BYTES = 16 << 20
#: A shard ends after so many words of runs, or so many bytes of text.
SHARD_WORDS, SHARD_BYTES = 1 << 19, 16 << 20

SPANS = "array<struct<first_word:int,last_word:int,start_byte:int,end_byte:int>>"
RESULT = {"n_words": "long", "n_hit": "long", "n_items": "long", "item_ids": "array<string>", "spans": SPANS, "contaminated": "boolean"}


class FMIndex:
    """``symbols``: words from 1, with 0 between runs and at the end."""

    def __init__(self, symbols: np.ndarray, depth: int, sample: int = 32):
        order = suffix_array(symbols)
        before = symbols[order - 1]
        self.tree = WaveletMatrix.build(before.astype(np.uint32), depth)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << depth))])
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.positions = np.cumsum(kept), order[kept]
        self.is_kept, self.size = kept, len(symbols)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the sorted suffixes that begin with each phrase (a row of words): from low to before high."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for word in phrases.T[::-1]:
            offset = self.smaller[word]
            low, high = offset + self.tree.rank(word, low), offset + self.tree.rank(word, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of sorted suffixes, by steps back to a sampled one."""
        rows, out, walking, steps = rows.copy(), np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(walking):
            done = self.is_kept[rows]
            out[walking[done]] = self.positions[self.kept[rows[done]] - 1] + steps
            walking, rows = walking[~done], rows[~done]
            word = self.tree.access(rows)
            rows, steps = self.smaller[word] + self.tree.rank(word, rows), steps + 1
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the k-th separator is smaller than the next and than every word."""
    cut = symbols == 0
    rank = np.where(cut, np.cumsum(cut), symbols + int(cut.sum())).astype(np.int64)
    reach = 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[:-reach] = rank[reach:]
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))
        rank, reach = new, reach * 2
        if rank[order[-1]] == len(symbols) or reach >= len(symbols):
            return order


class Phrases(NamedTuple):
    """Distinct phrases of a block of items."""

    vocabulary: np.ndarray
    """Sorted hashes of their words; word i of the index is entry i - 1."""
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    """For each length: phrases as rows of words, and the items of phrase i as items[bounds[i]:bounds[i + 1]]."""
    ids: list[str | None]
    shortest: int


def phrases_of(rows: list, window: int) -> Phrases:
    """``rows``: (item_id, text)."""
    texts = pa.array([(r[1] or "").encode() for r in rows], pa.binary())
    words = words_of(*text_bytes(texts), ALNUM)
    vocabulary = np.unique(words.hash)
    number = np.searchsorted(vocabulary, words.hash) + 1
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for item, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if b > a:
            n = min(window, int(b - a))
            rows_ = np.lib.stride_tricks.sliding_window_view(number[a:b], n)
            found.setdefault(n, []).append((rows_, np.full(len(rows_), item)))
    by_length = []
    for n in sorted(found):
        every, item = (np.concatenate(x) for x in zip(*found[n], strict=True))
        distinct, which = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), item]), axis=1)
        by_length.append((distinct, pairs[1], np.searchsorted(pairs[0], np.arange(len(distinct) + 1))))
    return Phrases(vocabulary, by_length, [None if r[0] is None else str(r[0]) for r in rows], min(found, default=0))


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges [low, high), and the range it is of."""
    n = high - low
    of = np.repeat(np.arange(len(low)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of], of


class Shard:
    """Documents of a task, gathered until the index over their runs is built."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.rows, self.n_words, self.kept = phrases, [], [], []
        self.docs = self.bytes = self.words = 0

    def add(self, batch: pa.RecordBatch, text: str) -> None:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        words = words_of(data, offsets, ALNUM)
        vocabulary, row = self.phrases.vocabulary, words.row
        at = np.searchsorted(vocabulary, words.hash)
        if len(vocabulary):
            hit = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == words.hash)
            fresh = np.ones(len(hit), bool)  # begins a run
            fresh[1:] = (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)
            run = np.cumsum(fresh) - 1
            long = np.bincount(run, minlength=1)[run] >= self.phrases.shortest if len(hit) else np.zeros(0, bool)
            hit, fresh = hit[long], fresh[long]
            doc = row[hit]
            self.kept.append((at[hit] + 1, self.docs + doc, hit - words.first[doc], words.start[hit] - offsets[doc], words.end[hit] - offsets[doc], fresh))
            self.words += len(hit)
        self.rows.append(batch.drop_columns([TEXT]) if text == TEXT else batch)
        self.n_words.append(words.counts)
        self.docs += batch.num_rows
        self.bytes += len(data)

    def hits(self) -> tuple[dict[int, list[dict]], dict[int, set[int]]]:
        """Merged spans and items by document of the shard."""
        spans: dict[int, list[dict]] = {}
        items: dict[int, set[int]] = {}
        if not self.words:
            return spans, items
        word, doc, place, start, end, fresh = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        run = np.cumsum(fresh) - 1
        at = np.arange(len(word)) + run  # a separator after each run
        symbols = np.zeros(len(word) + int(run[-1]) + 1, np.int64)
        symbols[at] = word
        back = np.zeros(len(symbols), np.int64)
        back[at] = np.arange(len(word))
        index = FMIndex(symbols, len(self.phrases.vocabulary).bit_length())
        firsts, lasts = [], []
        for phrases, of_items, bounds in self.phrases.by_length:
            rows, which = spread(*index.search(phrases))
            first = back[index.locate(rows)]
            firsts.append(first)
            lasts.append(first + phrases.shape[1] - 1)
            pairs = np.unique(np.stack([doc[first], which]), axis=1) if len(first) else np.zeros((2, 0), np.int64)
            item, pair = spread(bounds[pairs[1]], bounds[pairs[1] + 1])
            for d, i in zip(pairs[0][pair].tolist(), of_items[item].tolist(), strict=True):
                items.setdefault(d, set()).add(i)
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        if not len(first):
            return spans, items
        order = np.argsort(first, kind="stable")
        first, last = first[order], np.maximum.accumulate(last[order])
        opens = np.ones(len(first), bool)  # kept words of one run that follow each other
        opens[1:] = (first[1:] > last[:-1] + 1) | (run[first[1:]] != run[last[:-1]])
        a, b = first[opens], last[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(first) - 1]])]
        for d, *span in zip(*(x.tolist() for x in (doc[a], place[a], place[b], start[a], end[b])), strict=True):
            spans.setdefault(d, []).append(dict(zip(("first_word", "last_word", "start_byte", "end_byte"), span, strict=True)))
        return spans, items

    def result(self, schema: pa.Schema) -> pa.RecordBatch:
        spans, items = self.hits()
        rows = pa.Table.from_batches(self.rows)
        n_words = np.concatenate(self.n_words)
        all_spans = [spans.get(d, []) for d in range(self.docs)]
        all_ids = [{self.phrases.ids[i] for i in items.get(d, ())} - {None} for d in range(self.docs)]
        if "r0" in rows.column_names:  # what the passes over other blocks of the benchmark found
            for d, (old_spans, old_ids) in enumerate(zip(rows["r0"].to_pylist(), rows["r1"].to_pylist(), strict=True)):
                all_spans[d], all_ids[d] = union(all_spans[d], old_spans), all_ids[d] | set(old_ids)
        n_hit = [sum(s["last_word"] - s["first_word"] + 1 for s in x) for x in all_spans]
        contaminated = [h > 0 and HIT_SHARE * h >= n for h, n in zip(n_hit, n_words.tolist(), strict=True)]
        made = [n_words, n_hit, [len(x) for x in all_ids], [sorted(x) for x in all_ids], all_spans, contaminated]
        kept = [rows[f.name].combine_chunks() if rows.num_rows else pa.array([], f.type) for f in schema if f.name in rows.column_names]
        columns = [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip([*kept, *made], schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def union(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(a + b, key=lambda s: s["first_word"]):
        if out and s["first_word"] <= out[-1]["last_word"] + 1:
            out[-1] = out[-1] | {k: max(out[-1][k], s[k]) for k in ("last_word", "end_byte")}
        else:
            out.append(s)
    return out


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``carry`` (all columns of ``docs`` by default) with the columns of RESULT. ``spans`` are the merged removal spans,
    in words from 0 and in bytes of the UTF-8 text."""
    spark = docs.sparkSession
    carry = carried(docs, carry, list(RESULT))
    found = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    bytes_ = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-bytes_ // block_bytes))
    numbered = found.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    made = T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in RESULT.items()))
    out = docs
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).select("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(phrases_of(rows, window))
        last = block == blocks - 1
        kept = carry if last or "text" in carry else [*carry, "text"]
        out = map_rows(out, kept, "text", _search(sent), made, ["spans", "item_ids"] if block else None)
        if not last:
            out = materialise(out, "decontamination")
    return out


def _search(sent):
    def search(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        shard = Shard(sent.value)
        for piece in pieces(batches, text):
            shard.add(piece, text)
            if shard.words >= SHARD_WORDS or shard.bytes >= SHARD_BYTES:
                yield shard.result(schema)
                shard = Shard(sent.value)
        if shard.docs:
            yield shard.result(schema)

    return search


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return scan(docs, items, window).where(~F.col("contaminated")).select(*(named(c) for c in docs.columns))


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents with their removal spans cut out of the text, and the number of words cut."""
    found = scan(docs, items, window)
    others = [c for c in docs.columns if c != "text"]

    def cut(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            texts = [t if not s else _cut(t, s) for t, s in zip(piece[text].to_pylist(), piece["r0"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(piece[f"c{i}"] for i in range(len(others))), pa.array(texts, pa.binary()).cast(pa.string()), piece["r1"]], schema=schema)

    made = T._parse_datatype_string("text string, n_cut long")
    return map_rows(found, others, "text", cut, made, ["spans", "n_hit"]).select(*(named(c) for c in docs.columns), "n_cut")


def _cut(text: bytes, spans: list[dict]) -> bytes:
    parts, at = [], 0
    for s in spans:
        parts.append(text[at : s["start_byte"]])
        at = s["end_byte"]
    return b"".join([*parts, text[at:]])
