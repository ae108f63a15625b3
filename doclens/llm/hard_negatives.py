"""Hard negatives by bit-sliced integer products.

Components become integers, and a row's score is its exact inner product with the anchor. A tile of candidates is cut into bit planes, most
significant first, the sign before all. A plane adds its share to the scores of a tile of anchors, and what the planes below can still add or
take away bounds them: by anchor, the sum of its positive (or negative) components times what is left of a candidate's. The intervals
tighten from plane to plane, and a candidate is dropped for an anchor once its interval cannot qualify:

* as a positive, when it ends below the k-th best lower end so far;
* as a negative, when it meets none of the anchor's windows of scores (from ``low`` of a positive's score up to it), or only windows that
  have k candidates sure to lie in them and better.

While many pairs are left the planes are multiplied tile by tile; later only the pairs left are. After the last plane intervals are scores.

Two searches, first positives, then negatives: anchors in blocks and rows in slices of bounded size, each block and slice being a cell that streams
through one task. For positives a cell has one label, so a label with a third of all rows is many cells. Only a cell's best k for each
anchor (and positive) leave it.

Cases: rows with a null label, a null vector or a null or non-finite component take no part; rows with a null vec_id are neither anchors nor
positives nor negatives. Vectors are compared with those of equal length only. Zero and empty vectors score 0. A repeated vec_id is as many rows: each
an anchor of its own and a candidate for every other row. Ties go by vec_id; where fewer qualify, all are returned; a positive without
negatives has no row; components whose products could leave 64 bits are an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm.integers import EXACT, finite, whole
from doclens.llm.words import released
from doclens.session import discard, materialise

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score is between these per cent of the positive's.
LOW, HIGH = 80, 100
SLICE_ROWS, BLOCK_ROWS = 65_536, 16_384
#: Anchors and candidates whose planes are multiplied at once, and the share of pairs left below which pairs are looked at one by one.
ANCHORS, TILE, FEW = 64, 2048, 1 / 16
#: Positives of an anchor, whose windows are looked at together.
POSITIVES_MOST = 64
NOTHING = np.iinfo(np.int64).min


def bits_of(x: np.ndarray) -> int:
    """Planes below the sign."""
    return max(1, int(max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)).bit_length())


class Tile:
    """Candidates, and their bit planes."""

    def __init__(self, x: np.ndarray):
        self.x, self.bits = x, bits_of(x)

    def plane(self, b: int) -> np.ndarray:
        """0 or 1 for each component; plane ``bits`` is the sign's."""
        return (self.x < 0) if b == self.bits else (self.x >> b & 1).astype(bool)


def kind_of(d: int, a: np.ndarray, x: np.ndarray) -> type:
    """Numbers in which all sums of products are exact."""
    return np.float64 if (d + 1) * (int(np.abs(a).max(initial=0)) + 1) << (bits_of(x) + 1) < EXACT else np.int64


class Test:
    """What a pair's interval of scores must meet. ``narrow`` looks at anchors x candidates and may raise its bars; ``passes`` at single pairs."""

    def narrow(self, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def passes(self, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def sliced(anchors: np.ndarray, tile: Tile, alive: np.ndarray, test: Test) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, candidate and score of the pairs of ``alive`` (anchors x candidates) that still pass after the last plane."""
    kind = kind_of(anchors.shape[1], anchors, tile.x)
    a = anchors.astype(kind)
    up, down = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)
    columns = np.flatnonzero(alive.any(0))
    alive, partial = alive[:, columns], np.zeros((len(a), len(columns)), kind)
    pairs = None
    for b in range(tile.bits, -1, -1):
        weight, rest, plane = -(1 << b) if b == tile.bits else 1 << b, (1 << b) - 1, tile.plane(b)
        if pairs is None:
            partial += weight * (a @ plane[columns].T.astype(kind))
            alive = test.narrow(alive, partial + rest * down[:, None], partial + rest * up[:, None])
            some = alive.any(0)
            if not some.all():
                columns, alive, partial = columns[some], alive[:, some], partial[:, some]
            if alive.sum() <= FEW * len(a) * len(tile.x):
                i, j = np.nonzero(alive)
                pairs = i, columns[j], partial[i, j]
        else:
            i, j, score = pairs
            score = score + weight * np.einsum("ij,ij->i", a[i], plane[j].astype(kind))
            kept = test.passes(i, score + rest * down[i], score + rest * up[i])
            pairs = i[kept], j[kept], score[kept]
    if pairs is None:
        i, j = np.nonzero(alive)
        pairs = i, columns[j], partial[i, j]
    return pairs[0], pairs[1], pairs[2].astype(np.int64)


def kth_largest(value: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """For each row the k-th largest value where ``of`` holds, or NOTHING if there are fewer."""
    if value.shape[1] < k:
        return np.full(len(value), NOTHING)
    return np.partition(np.where(of, value, NOTHING), -k, axis=1)[:, -k].astype(np.int64)


class Best(Test):
    """The k best of each anchor: no interval may end below the k-th best lower end."""

    def __init__(self, bars: np.ndarray, k: int):
        self.bars, self.k = bars.copy(), k

    def narrow(self, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        self.bars = np.maximum(self.bars, kth_largest(low, alive, self.k))
        return alive & (high >= self.bars[:, None])

    def passes(self, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= self.bars[i]


class Inside(Test):
    """The k best in one at least of each anchor's windows (anchors x windows)."""

    def __init__(self, bottom: np.ndarray, top: np.ndarray, bars: np.ndarray, k: int):
        self.bottom, self.top, self.bars, self.k = bottom, top, bars.copy(), k

    def narrow(self, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        kept = np.zeros(alive.shape, bool)
        for w in range(self.bars.shape[1]):
            bottom, top = self.bottom[:, w, None], self.top[:, w, None]
            if alive.size and (high - low).min() <= (top - bottom).max():  # else none is sure to lie inside
                self.bars[:, w] = np.maximum(self.bars[:, w], kth_largest(low, alive & (low >= bottom) & (high <= top), self.k))
            kept |= (high >= np.maximum(bottom, self.bars[:, w, None])) & (low <= top)
        return alive & kept

    def passes(self, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return ((high[:, None] >= np.maximum(self.bottom, self.bars)[i]) & (low[:, None] <= self.top[i])).any(1)


def best_of(of: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows for each ``of``: highest score, then smallest id; in order."""
    order = np.lexsort((ids, -score, of))
    own = of[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def kth_best(of: np.ndarray, score: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th score for each of n, whose rows stand best first, or NOTHING if there are fewer."""
    out = np.full(n, NOTHING)
    last = np.flatnonzero(np.arange(len(of)) - np.searchsorted(of, of) == k - 1)
    out[of[last]] = score[last]
    return out


class Cell:
    """A block of anchors, against which a slice of rows streams by."""

    def __init__(self, name: tuple, k: int):
        self.name, self.k = name, k
        self.rows: list = []
        self.anchors: dict[str, np.ndarray] | None = None
        self.of, self.found, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def ask(self, part: dict) -> None:
        self.rows.append(part)

    def ready(self) -> None:
        if self.anchors is None and self.rows:
            self.anchors = {c: np.concatenate([r[c] for r in self.rows]) for c in self.rows[0]}
            self.start()

    def start(self) -> None:
        self.bars = np.full(len(self.anchors["row_id"]), NOTHING)

    def offer(self, rows: dict) -> None:
        self.ready()
        if self.anchors is None:
            return
        for low in range(0, len(rows["row_id"]), TILE):
            part = {c: v[low : low + TILE] for c, v in rows.items()}
            tile = Tile(part["x"])
            for first in range(0, len(self.anchors["row_id"]), ANCHORS):
                self.compare(first, part, tile)

    def compare(self, first: int, part: dict, tile: Tile) -> None:
        """Positives: other rows of the label."""
        last = first + ANCHORS
        other = self.anchors["row_id"][first:last, None] != part["row_id"]
        i, j, score = sliced(self.anchors["x"][first:last], tile, other, Best(self.bars[first:last], self.k))
        self.keep(i + first, part["vec_id"][j], score)

    def keep(self, of: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        of, ids, score = np.concatenate([self.of, of]), np.concatenate([self.found, ids]), np.concatenate([self.score, score])
        some = best_of(of, score, ids, self.k)
        self.of, self.found, self.score = of[some], ids[some], score[some]
        self.bars = kth_best(self.of, self.score, self.k, len(self.bars))

    def result(self) -> list[pa.Array]:
        return [pa.array(self.anchors["row_id"][self.of] if self.anchors else self.of), pa.array(self.found), pa.array(self.score)]


class Windows(Cell):
    """Anchors with the scores of their positives; what is found is told by anchor and positive."""

    def start(self) -> None:
        of = self.anchors["positives"]  # anchors x positives, NOTHING where there are fewer
        self.width, none = of.shape[1], of == NOTHING
        of = np.where(none, 0, of)
        self.bottom, self.top = np.where(none, 1, -(-LOW * of // 100)), np.where(none, 0, HIGH * of // 100)
        self.bars = np.full(of.size, NOTHING)

    def compare(self, first: int, part: dict, tile: Tile) -> None:
        last, width = first + ANCHORS, self.width
        other = self.anchors["label"][first:last, None] != part["label"]
        bottom, top = self.bottom[first:last], self.top[first:last]
        test = Inside(bottom, top, self.bars[first * width : last * width].reshape(-1, width), self.k)
        i, j, score = sliced(self.anchors["x"][first:last], tile, other, test)
        at, nth = np.nonzero((score[:, None] >= bottom[i]) & (score[:, None] <= top[i]))
        self.keep((i[at] + first) * width + nth, part["vec_id"][j[at]], score[at])

    def result(self) -> list[pa.Array]:
        at, nth = (self.of // self.width, self.of % self.width) if self.anchors else (self.of, self.of)
        return [pa.array(self.anchors["row_id"][at] if self.anchors else at), pa.array(nth.astype(np.int32)), pa.array(self.found), pa.array(self.score)]


def most(dimensions: int) -> int:
    """Largest component for which a hundred times a score stays in 64 bits."""
    return math.isqrt((1 << 56) // max(1, dimensions))


def _whole_rows(scale: int):
    """row_id, vec_id, label, d, x for rows of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.asarray(batch["v"].value_lengths())
            at, x = whole(batch["v"], scale, most(int(lengths.max())))
            raw = [x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row_id"], batch["vec_id"], batch["label"], batch["asks"], pa.array(lengths.astype(np.int32)), pa.array(raw, pa.binary())], ["row_id", "vec_id", "label", "asks", "d", "x"])

    return run


def _cells(make, keys: list[str], k: int, names: list[str], most_positives: int = 0):
    """Cells of sorted rows: anchors (kind 0) come before the rows (kind 1)."""

    def arrays(part: pa.RecordBatch, d: int) -> dict:
        out = {c: np.asarray(part[c]) for c in ("row_id", "vec_id", "label")}
        out["x"] = np.frombuffer(b"".join(part["x"].to_pylist()), np.int64).reshape(len(out["row_id"]), d)
        if "positives" in part.schema.names and part["positives"].null_count < part.num_rows:
            lists = [[s["score"] for s in p] for p in part["positives"].to_pylist()]
            out["positives"] = np.array([p + [NOTHING] * (most_positives - len(p)) for p in lists], np.int64)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for batch in batches:
            key = np.stack([np.asarray(batch[c]).astype(np.int64) for c in [*keys, "kind"]])
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high == low:
                    continue
                name, kind = tuple(key[:-1, low].tolist()), int(key[-1, low])
                if cell is None or cell.name != name:
                    if cell is not None:
                        yield pa.RecordBatch.from_arrays(cell.result(), names)
                    cell = make(name, k)
                part = arrays(batch.slice(low, high - low), int(name[0]))
                cell.ask(part) if kind == 0 else cell.offer(part)
        if cell is not None:
            yield pa.RecordBatch.from_arrays(cell.result(), names)

    return run


def _dealt(asks: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Anchors and rows by cell, which ``keys``, a slice of the rows and a block of the anchors name. The numbers of slices and blocks are those of the key."""
    key = [F.col(c) for c in keys]
    count = lambda df, name, size: df.groupBy(*key).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias(name))
    cells = materialise(count(rows, "slices", SLICE_ROWS).join(count(asks, "blocks", BLOCK_ROWS), keys), "negatives-cells")
    place = lambda n: F.pmod(F.xxhash64("row_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = asks.join(cells, keys).withColumn("block", place("blocks")).withColumn("slice", every("slices")).withColumn("kind", F.lit(0))
    here = rows.join(cells, keys).withColumn("slice", place("slices")).withColumn("block", every("blocks")).withColumn("kind", F.lit(1))
    at = [*keys, "slice", "block"]
    return ask.select(*at, "kind", *columns).union(here.select(*at, "kind", *columns)).repartition(*at).sortWithinPartitions(*at, "kind")


def mine(
    base: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of its label, the ``negatives`` best rows of other labels whose scores are ``LOW`` to
    ``HIGH`` per cent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``label`` is a whole number."""
    if not 1 <= positives <= POSITIVES_MOST:
        raise ValueError(f"positives must be 1 to {POSITIVES_MOST}")
    label = F.col("label") if label is None else label
    usable = base.where(finite(embedding) & F.col(vec_id).isNotNull()).select(
        F.monotonically_increasing_id().alias("row_id"), F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col(embedding).alias("v")
    )
    made = usable.where("label is not null").mapInArrow(released(_whole_rows(scale)), "row_id long, vec_id long, label long, asks boolean, d int, x binary")
    rows = materialise(made, "negatives-rows")  # so that a lost task cannot number them anew
    columns = ["row_id", "vec_id", "label", "x"]
    asks = rows.where("asks")

    alike = _dealt(asks, rows, ["d", "label"], ["row_id", "vec_id", "x"]).select("*")
    near = alike.mapInArrow(released(_cells(Cell, ["d", "label", "slice", "block"], positives, ["row_id", "found", "score"])), "row_id long, found long, score long")
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "found"))
    best = near.withColumn("nth", place).where(F.col("nth") <= positives).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("nth", "found", "score"))).alias("positives"))
    told = materialise(asks.join(best, "row_id"), "negatives-anchors")

    without = lambda df: df.withColumn("positives", F.lit(None).cast(told.schema["positives"].dataType))
    others = _dealt(told, without(rows), ["d"], [*columns, "positives"])
    found = others.mapInArrow(released(_cells(Windows, ["d", "slice", "block"], negatives, ["row_id", "nth", "found", "score"], positives)), "row_id long, nth int, found long, score long")
    rank = F.row_number().over(Window.partitionBy("row_id", "nth").orderBy(F.desc("score"), "found"))
    ranked = materialise(found.withColumn("rank", rank).where(F.col("rank") <= negatives), "negatives-found")
    discard(rows)
    of = told.select("row_id", F.col("vec_id").alias("anchor_id"), "positives")
    positive = F.get("positives", F.col("nth"))
    return ranked.join(of, "row_id").select(
        "anchor_id", positive["found"].alias("positive_id"), "rank", F.col("found").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score")
    )
