"""Approximate nearest neighbours over learned partitions.

A bounded sample (``SAMPLE`` rows of least hash) gets its neighbour graph, whose nodes are cut into balanced parts by
capacity-bound label propagation, and a small network learns to tell from a vector which parts its neighbours lie in. Every
vector is indexed under its most probable part; a query goes to its most probable parts and what lies there is reranked by exact cosine
in double precision. How many parts that are is set by ``HELD`` further rows of the sample that neither graph nor network saw: as many as
find ``TARGET`` of their neighbours in the sample.

Parts are cut into slices and queries into blocks of bounded size; a cell of one slice and one block is streamed through
one task, so a part with a third of all vectors is many cells. Only a cell's best ``k`` for each query leave it. Queries for which their
parts hold fewer than k candidates are asked of the other parts too.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates; very large and very
small components are scaled before they are squared; vectors of another length than the most common of the sample, and rows with a null
vec_id, take no part either. A repeated vec_id is as many rows: each is a query of its own, with an answer of its own, and a candidate of
every other row, so that an answer may hold its query's vec_id. Repeated vectors tie and go by vec_id; with fewer than k candidates
all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm.words import released
from doclens.session import materialise

SAMPLE, HELD, GRAPH, TARGET = 8192, 1024, 10, 0.97
#: Parts: one for each PART_SAMPLE rows of the sample, to LEAST_PARTS; from there one for each PART_ROWS rows of the table.
LEAST_PARTS, MOST_PARTS, PART_SAMPLE, PART_ROWS = 16, 256, 64, 50_000
HIDDEN, STEPS, BATCH, RATE = 64, 600, 256, 0.01
SLICE_ROWS, BLOCK_ROWS, TILE = 20_000, 8_000, 2048
K = 5


def top(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest other rows of each (unit) row, a tile at a time."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for low in range(0, len(x), 1024):
        s = x[low : low + 1024] @ x.T
        s[np.arange(len(s)), low + np.arange(len(s))] = -2
        out[low : low + len(s)] = top(s, out.shape[1])
    return out


def balanced_parts(links: np.ndarray, x: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Parts of equal size with many links inside: each round the nodes, those most sure first, go to the part of most of
    their neighbours that has room."""
    n = len(links)
    room = -(-n // parts)
    part = np.empty(n, np.int64)  # at first, cuts along random directions into halves of equal size
    pending = [(np.arange(n), 0, parts)]
    while pending:
        rows, first, count = pending.pop()
        if count == 1:
            part[rows] = first
            continue
        order = rows[np.argsort(x[rows] @ rng.normal(size=x.shape[1]))]
        cut = len(rows) * (count // 2) // count
        pending += [(order[:cut], first, count // 2), (order[cut:], first + count // 2, count - count // 2)]
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), links.shape[1]), part[links].ravel()), 1.0)
        np.add.at(votes, (links.ravel(), np.repeat(part, links.shape[1])), 1.0)
        votes += 0.5 * (np.arange(parts) == part[:, None])
        wish = np.argsort(-votes, axis=1, kind="stable")
        ranked = np.take_along_axis(votes, wish, 1)
        size, new = np.zeros(parts, np.int64), np.empty(n, np.int64)
        for i in np.argsort(ranked[:, min(1, parts - 1)] - ranked[:, 0], kind="stable").tolist():
            for p in wish[i].tolist():
                if size[p] < room:
                    new[i], size[p] = p, size[p] + 1
                    break
        if (new == part).all():
            break
        part = new
    return part


class Router(NamedTuple):
    """Network from unit vectors to parts, and to how many parts a query goes."""

    layers: list[np.ndarray]
    parts: int
    probes: int
    dimensions: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.zeros((len(x), self.parts))
        return np.maximum(0, x @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, parts: int, k: int = K, seed: int = 3) -> Router:
    """``x``: unit vectors of the sample, in an order that does not depend on them. Of these the first eighth, ``HELD`` at most, is held
    back and sets the number of probes."""
    rng = np.random.default_rng(seed)
    d = x.shape[1] if x.ndim == 2 and len(x) else 0
    held, x = x[: min(HELD, len(x) // 8)], x[min(HELD, len(x) // 8) :]
    if parts < 2 or len(x) < 2 * parts or not len(held):  # too few rows for two parts
        return Router([], 1, 1, d)
    links = graph(x, GRAPH)
    part = balanced_parts(links, x, parts, rng)
    aim = np.zeros((len(x), parts))
    np.add.at(aim, (np.repeat(np.arange(len(x)), links.shape[1]), part[links].ravel()), 1.0)
    aim[np.arange(len(x)), part] += 1
    aim /= aim.sum(1, keepdims=True)
    layers = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
    for step in range(1, STEPS + 1):
        take = rng.integers(0, len(x), BATCH)
        hidden = np.maximum(0, x[take] @ layers[0] + layers[1])
        slope = (_softmax(hidden @ layers[2] + layers[3]) - aim[take]) / BATCH
        back = slope @ layers[2].T * (hidden > 0)
        for p, g, (m, v) in zip(layers, (x[take].T @ back, back.sum(0), hidden.T @ slope, slope.sum(0)), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    router = Router(layers, parts, parts, d)
    own = router.logits(x).argmax(1)
    rank_of = np.argsort(np.argsort(-router.logits(held), axis=1, kind="stable"), axis=1)  # place of each part in a held row's order
    needed = np.take_along_axis(rank_of, own[top(held @ x.T, min(k, len(x)))], 1)
    recall = np.array([(needed < p).mean() for p in range(1, parts + 1)])
    return router._replace(probes=int(np.argmax(recall >= TARGET)) + 1)


def vectors(column: pa.Array, dimensions: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that take part, their vectors in double precision, and unit vectors of these."""
    if pa.types.is_fixed_size_list(column.type) or pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    lengths = np.asarray(column.value_lengths().fill_null(-1)).astype(np.int64)
    d = dimensions or (int(np.bincount(lengths[lengths > 0]).argmax()) if (lengths > 0).any() else 0)
    rows = np.flatnonzero(lengths == d) if d else np.zeros(0, np.int64)
    if not len(rows):
        return rows, np.zeros((0, d)), np.zeros((0, d))
    values = np.asarray(column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, d)
    good = np.isfinite(values).all(1) & (values != 0).any(1)
    return rows[good], values[good], unit(values[good])


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; components are brought near 1 first, so that no square is too large or too small."""
    x = x * np.exp2(-np.frexp(np.abs(x).max(1, initial=0.0))[1].astype(np.float64) / 2)[:, None]  # in two steps, as the power may be out of range
    x = x * np.exp2(-np.frexp(np.abs(x).max(1, initial=0.0))[1].astype(np.float64))[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray, unit_a: np.ndarray, unit_b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``: the dot product over the norms where their squares are in range, else that of the
    unit vectors."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        squares = np.stack([(a * a).sum(1), (b * b).sum(1)])
        plain = np.einsum("ij,ij->i", a, b) / (np.sqrt(squares[0]) * np.sqrt(squares[1]))
    usual = ((squares > 1e-200) & (squares < 1e200)).all(0)
    return np.where(usual, plain, np.einsum("ij,ij->i", unit_a, unit_b))


def train(base: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> Router:
    n = base.count()
    rows = base.where(F.col(embedding).isNotNull()).select(vec_id, embedding).orderBy(F.xxhash64(vec_id, embedding), vec_id).limit(SAMPLE).toArrow()
    column = rows[embedding].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float32()))
    x = vectors(column)[2]
    parts = max(1, min(LEAST_PARTS, len(x) // PART_SAMPLE), min(MOST_PARTS, n // PART_ROWS))
    return fit(x, parts)


INDEX = "part int, nth int, row_id long, vec_id long, vec binary"


def numbered(base: DataFrame, is_query: Column, vec_id: str, embedding: str) -> DataFrame:
    """Rows with a number for each (row_id), of no meaning but that no two rows share it."""
    known = base.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
    rows = known.select(F.monotonically_increasing_id().alias("row_id"), F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), is_query.alias("asks"))
    return materialise(rows, "neighbours-rows")  # so that a lost task cannot number them anew


def routed(rows: DataFrame, router: Router, probes: int) -> DataFrame:
    """Each vector under its ``probes`` most probable parts; nth is the place of the part in its order."""

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x, one = vectors(batch["v"], router.dimensions)
            if not len(keep):
                continue
            order = np.argsort(-router.logits(one), axis=1, kind="stable")[:, :probes]
            ids = [pa.array(np.repeat(np.asarray(batch[c].take(pa.array(keep))), order.shape[1])) for c in ("row_id", "id")]
            raw = [r.tobytes() for r in x]
            vec = pa.array(raw, pa.binary()).take(pa.array(np.repeat(np.arange(len(x)), order.shape[1])))
            nth = np.tile(np.arange(order.shape[1], dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), pa.array(nth), *ids, vec], ["part", "nth", "row_id", "vec_id", "vec"])

    return rows.select("row_id", "id", "v").mapInArrow(released(parts_of), INDEX)


def search(base: DataFrame, is_query: Column, k: int = K, router: Router | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row of ``base`` where ``is_query`` holds: query_id, rank, vec_id and score of its k nearest found."""
    router = router or train(base, vec_id, embedding)
    if not router.dimensions:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = numbered(base, is_query, vec_id, embedding)
    index = materialise(routed(rows, router, 1).drop("nth"), "neighbours-index")
    sizes = {r.part: r["count"] for r in index.groupBy("part").count().collect()}  # a row for each part
    asks = rows.where("asks")
    first = materialise(_nearest(routed(asks, router, router.probes), index, sizes, router, k), "neighbours-found")
    if router.probes < router.parts:  # queries whose parts hold too few candidates go on to the others
        enough = first.groupBy("row_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("row_id")
        few = asks.join(enough, "row_id", "left_anti")
        first = first.union(_nearest(routed(few, router, router.parts).where(F.col("nth") >= router.probes), index, sizes, router, k))
    best = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "vec_id"))
    return first.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(asked: DataFrame, index: DataFrame, sizes: dict[int, int], router: Router, k: int) -> DataFrame:
    """row_id, query_id, vec_id and score of the nearest k rows in each slice of a part that a query goes to."""
    asked = materialise(asked.drop("nth"), "neighbours-queries")
    asks = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}
    cells = [(p, max(1, -(-sizes.get(p, 0) // SLICE_ROWS)), max(1, -(-asks.get(p, 0) // BLOCK_ROWS))) for p in range(router.parts) if asks.get(p)]
    counts = F.broadcast(index.sparkSession.createDataFrame(cells, "part int, slices int, blocks int"))  # a row for each part
    place = lambda n: F.pmod(F.xxhash64("row_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = asked.join(counts, "part").withColumn("slice", every("slices")).withColumn("block", place("blocks")).withColumn("kind", F.lit(0))
    here = index.join(counts, "part").withColumn("slice", place("slices")).withColumn("block", every("blocks")).withColumn("kind", F.lit(1))
    columns = ["part", "slice", "block", "kind", "row_id", "vec_id", "vec"]
    dealt = ask.select(columns).union(here.select(columns)).repartition("part", "slice", "block").sortWithinPartitions("part", "slice", "block", "kind")
    return dealt.mapInArrow(released(_cells(router.dimensions, k)), "row_id long, query_id long, vec_id long, score double")


def _cells(d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: Cell | None = None
        for batch in batches:
            key = np.stack([np.asarray(batch[c]) for c in ("part", "slice", "block", "kind")])
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                name, kind = tuple(key[:3, low].tolist()), int(key[3, low])
                if cell is None or cell.name != name:
                    if cell is not None:
                        yield from cell.result()
                    cell = Cell(name, d, k)
                part = batch.slice(low, high - low)
                x = np.frombuffer(b"".join(part["vec"].to_pylist()), np.float64).reshape(-1, d)
                (cell.ask if kind == 0 else cell.offer)(np.asarray(part["row_id"]), np.asarray(part["vec_id"]), x)
        if cell is not None:
            yield from cell.result()

    return run


class Cell:
    """A block of queries, against which a slice of the index streams by."""

    def __init__(self, name: tuple, d: int, k: int):
        self.name, self.k = name, k
        self.rows, self.ids, self.x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, d))
        self.of, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def ask(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.rows, self.ids, self.x = np.concatenate([self.rows, rows]), np.concatenate([self.ids, ids]), np.concatenate([self.x, x])
        self.unit = unit(self.x)
        self.least = np.full(len(self.ids), -np.inf)

    def offer(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(self.ids):
            return
        for low in range(0, len(ids), TILE):
            number, own, v = rows[low : low + TILE], ids[low : low + TILE], x[low : low + TILE]
            one = unit(v)
            for q in range(0, len(self.ids), 1024):
                near = self.unit[q : q + 1024] @ one.T
                near[self.rows[q : q + 1024, None] == number] = -2
                cut = self.least[q : q + 1024].copy()
                if len(own) > self.k:
                    cut = np.maximum(cut, -np.partition(-near, self.k - 1, axis=1)[:, self.k - 1])
                a, b = np.nonzero((near >= cut[:, None] - 1e-9) & (near > -1.5))  # ties are settled by the exact score
                a += q
                self.keep(a, own[b], cosine(self.x[a], v[b], self.unit[a], one[b]))

    def keep(self, of: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        of, ids, score = np.concatenate([self.of, of]), np.concatenate([self.found, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, of))
        of, ids, score = of[order], ids[order], score[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        some = place < self.k
        self.of, self.found, self.score, place = of[some], ids[some], score[some], place[some]
        last = place == self.k - 1
        self.least[self.of[last]] = self.score[last]

    def result(self) -> Iterator[pa.RecordBatch]:
        if len(self.of):
            yield pa.RecordBatch.from_arrays([pa.array(self.rows[self.of]), pa.array(self.ids[self.of]), pa.array(self.found), pa.array(self.score)], ["row_id", "query_id", "vec_id", "score"])
