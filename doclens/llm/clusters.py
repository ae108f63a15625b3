"""Centroid clustering in exact integers, by exponion search.

Components become integers, and the centroids are integers too, so distances, sums and ties are exact at every size of the input. A vector keeps
an upper bound on the distance to its centroid and a lower bound on that to any other. A round moves the bounds by how far the centroids
moved. A vector whose upper bound is below the lower one, or below half the way to the next centroid, stays. For others the upper
bound is made exact, and if that does not help, only centroids inside a ball around its present one are looked at: those at a distance of
``2 * upper + gap`` or less, where gap is the way to the next centroid, a stretch of that centroid's sorted list of the others. The
radius counts as inside, and bounds are rounded outward, so equally near centroids are always seen and the smaller number wins.

Vectors are written once, in blocks of ``BLOCK_ROWS`` rows, as a table bucketed by block; their cluster and bounds, a fifteenth of their size,
are a table of each round that joins them bucket by bucket, so vectors are not shuffled again. A round hands on what moved: sums and
counts that clusters win and lose, added up by Spark to a row for each cluster and component (at most ``MOST_CLUSTERS`` times the
dimensions), which the driver turns into centroids. Tasks get the centroids and the lists of their distances, ``MOST_CLUSTERS`` squared at most.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part; zero vectors and repeated rows do,
each row as one of its own. Rows with a null vec_id are clustered, and are the last to start a centroid; rows of equal vec_ids stand in order
of their vectors. With fewer vectors than clusters each starts one. Components whose squared distances could leave 64 bits are an error. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.integers import EXACT, finite, whole
from doclens.llm.words import released
from doclens.session import discard, materialise, scratch_path

K, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
MOST_CLUSTERS = 2048
BLOCK_ROWS = 4096
#: Blocks of a bucket.
BUCKET_BLOCKS = 16
#: Bounds are rounded outward by this share, far above what rounding loses.
SLACK = 1e-12


class Centroids(NamedTuple):
    """Centroids, their distances to each other and how far they moved."""

    values: np.ndarray
    """A row of integers for each."""
    order: np.ndarray
    """For each the others, nearest first."""
    ways: np.ndarray
    """Distances to these."""
    moved: np.ndarray
    """Upper bound on the way of each since the last round."""

    @classmethod
    def of(cls, values: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        k = len(values)
        ways = np.sqrt(np.stack([squares(values, values[j : j + 1])[:, 0] for j in range(k)]).astype(np.float64))
        np.fill_diagonal(ways, -1.0)
        order = np.argsort(ways, axis=1, kind="stable")[:, 1:]
        moved = np.zeros(k) if before is None else np.sqrt(((values - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        return cls(values, order, np.take_along_axis(ways, order, 1), moved)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` to each of ``c``."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if x.shape[1] * reach * reach < EXACT:  # every step is exact in double precision
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


class Block(NamedTuple):
    """Clusters and bounds of a block's vectors."""

    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def scanned(x: np.ndarray, numbers: np.ndarray, c: Centroids) -> Block:
    """Nearest of the centroids ``numbers``, ties to the smaller, and bounds from the two nearest."""
    numbers = np.sort(numbers)
    d = squares(x, c.values[numbers])
    best = d.argmin(1)
    second = np.partition(d, 1, axis=1)[:, 1] if len(numbers) > 1 else np.full(len(x), np.inf)
    return Block(numbers[best], np.sqrt(d[np.arange(len(x)), best].astype(np.float64)) * (1 + SLACK), np.sqrt(second.astype(np.float64)) * (1 - SLACK))


def reassigned(x: np.ndarray, state: Block, c: Centroids) -> Block:
    """The block after the centroids moved to ``c``."""
    k = len(c.values)
    if k == 1:
        return state
    near, upper = state.near.copy(), (state.upper + c.moved[state.near]) * (1 + SLACK)
    farthest = np.argmax(c.moved)
    second = np.partition(c.moved, -2)[-2]
    lower = np.maximum(0.0, state.lower - np.where(near == farthest, second, c.moved[farthest])) * (1 - SLACK)
    gap = c.ways[:, 0]
    safe = lambda rows: upper[rows] < np.maximum(lower[rows], gap[near[rows]] * (0.5 - SLACK))
    rows = np.flatnonzero(~safe(slice(None)))
    for a in np.unique(near[rows]).tolist():  # upper bounds made exact
        own = rows[near[rows] == a]
        upper[own] = np.sqrt(squares(x[own], c.values[a : a + 1])[:, 0].astype(np.float64)) * (1 + SLACK)
    rows = rows[~safe(rows)]
    radius = (2 * upper[rows] + gap[near[rows]]) * (1 + SLACK)
    for a in np.unique(near[rows]).tolist():
        own = near[rows] == a
        inside = np.searchsorted(c.ways[a], radius[own], "right")  # the radius itself counts
        steps = np.minimum(k - 1, 1 << np.ceil(np.log2(np.maximum(1, inside))).astype(np.int64))  # stretches of doubling length
        for n in np.unique(steps).tolist():
            some = rows[own][steps == n]
            found = scanned(x[some], np.append(c.order[a, :n], a), c)
            near[some], upper[some], lower[some] = found
    return Block(near, upper, lower)


def gains(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums that each cluster wins or loses."""
    moved = np.arange(len(x)) if before is None else np.flatnonzero(before != after)
    n, sums = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
    for numbers, sign in ((after, 1), (before, -1)):
        if numbers is not None and len(moved):
            order = moved[np.argsort(numbers[moved], kind="stable")]
            own, first = np.unique(numbers[order], return_index=True)
            n[own] += sign * np.diff([*first, len(order)])
            sums[own] += sign * np.add.reduceat(x[order], first, axis=0)
    return n, sums


def most(dimensions: int) -> int:
    """Largest component for which squared distances stay in 64 bits."""
    return math.isqrt((1 << 61) // dimensions)


def _blocks(dimensions: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                x = whole(part["v"], scale, most(dimensions))[1].astype(np.int32 if most(dimensions) < 1 << 31 else np.int64)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part["id"].cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([first + number]), ids, pa.array([x.tobytes()], pa.binary())], ["block", "ids", "x"])
                number += 1

    return run


def _matrix(raw: bytes, dimensions: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if most(dimensions) < 1 << 31 else np.int64).reshape(-1, dimensions).astype(np.int64)


def _state(batch: pa.RecordBatch, i: int) -> Block | None:
    raw = [batch[c][i].as_py() for c in ("near", "upper", "lower")]
    return None if raw[0] is None else Block(*(np.frombuffer(r, t).copy() for r, t in zip(raw, (np.int32, np.float64, np.float64), strict=True)))


def _next(x: np.ndarray, state: Block | None, c: Centroids) -> Block:
    return scanned(x, np.arange(len(c.values)), c) if state is None else reassigned(x, state, c)


STATE = "block long, near binary, upper binary, lower binary"


def _round(sent, dimensions: int):
    """Rows (block, near, upper, lower), and at the end of a task rows (cluster, n, sums) of what clusters win and lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        k = len(c.values)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        columns = ["block", "near", "upper", "lower", "cluster", "n", "sums"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            for i in range(batch.num_rows):
                x, state = _matrix(batch["x"][i].as_py(), dimensions), _state(batch, i)
                new = _next(x, state, c)
                more = gains(x, None if state is None else state.near, new.near, k)
                n, sums = n + more[0], sums + more[1]
                values = [batch["block"][i].as_py(), *(v.astype(t).tobytes() for v, t in zip(new, (np.int32, np.float64, np.float64), strict=True)), None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], columns)
        some = np.flatnonzero(n.astype(bool) | sums.any(1))
        values = [*([None] * len(some) for _ in range(4)), some.tolist(), n[some].tolist(), sums[some].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], columns)

    return run


def _last(sent, dimensions: int):
    """vec_id, cluster and squared distance of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                x = _matrix(batch["x"][i].as_py(), dimensions)
                near = _next(x, _state(batch, i), c).near
                gone = np.empty(len(x), np.int64)
                for a in np.unique(near).tolist():
                    gone[near == a] = squares(x[near == a], c.values[a : a + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([batch["ids"].slice(i, 1).flatten(), pa.array(near.astype(np.int32)), pa.array(gone)], ["vec_id", "cluster", "distance"])

    return run


def starts(usable: DataFrame, k: int, scale: int, seed: int, dimensions: int) -> np.ndarray:
    """The k vectors of smallest hash, in its order."""
    ticket = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = usable.orderBy(ticket.asc_nulls_last(), "v").limit(k).toArrow()
    if not rows.num_rows:
        return np.zeros((0, dimensions), np.int64)
    return whole(rows["v"].combine_chunks(), scale, most(dimensions))[1].reshape(-1, dimensions)


def bucketed(spark: SparkSession, blocks: DataFrame) -> tuple[DataFrame, str]:
    """The blocks as a table of buckets, one file each, and its name."""
    written = materialise(blocks, "cluster-blocks")
    buckets = max(1, -(-written.count() // BUCKET_BLOCKS))
    name = f"doclens_vectors_{uuid.uuid4().hex}"
    rows = written.repartition(buckets, "block").sortWithinPartitions("block")
    rows.write.format("parquet").option("path", scratch_path(spark, "cluster-vectors")).bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    discard(written)
    return spark.table(name), name


def cluster(base: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each vector that takes part: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256."""
    if not 1 <= k <= MOST_CLUSTERS:
        raise ValueError(f"k must be 1 to {MOST_CLUSTERS}")
    spark = base.sparkSession
    usable = base.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")).where((F.size("v") == dimensions) & finite("v"))
    centroids = starts(usable, k, scale, seed, dimensions)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    vectors, name = bucketed(spark, usable.mapInArrow(released(_blocks(dimensions, scale)), "block long, ids array<long>, x binary"))
    state, c = None, Centroids.of(centroids)
    n, sums = [0] * len(centroids), [[0] * dimensions for _ in centroids]

    def joined() -> DataFrame:
        none = [F.lit(None).cast("binary").alias(b) for b in ("near", "upper", "lower")]
        return vectors.select("*", *none) if state is None else vectors.join(state.where("block is not null").select("block", "near", "upper", "lower").hint("merge"), "block")

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(c)
        moved = materialise(joined().select("block", "x", "near", "upper", "lower").mapInArrow(released(_round(sent, dimensions)), f"{STATE}, cluster int, n long, sums array<long>"), "cluster-state")
        if state is not None:
            discard(state)
        state = moved
        won = state.where("cluster is not null").select("cluster", "n", F.posexplode("sums").alias("at", "sum")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        for r in won.collect():  # a row for each cluster and component
            sums[r.cluster][r["at"]] += r["sum"]
            n[r.cluster] += r.n if r["at"] == 0 else 0
        values = np.array([[s // n[j] for s in sums[j]] if n[j] else c.values[j].tolist() for j in range(len(n))], np.int64)
        c = Centroids.of(values, c.values)
    sent = spark.sparkContext.broadcast(c)
    found = materialise(joined().select("ids", "x", "near", "upper", "lower").mapInArrow(released(_last(sent, dimensions)), "vec_id long, cluster int, distance long"), "clusters")
    spark.sql(f"DROP TABLE {name}")
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row for each cluster
    total = sum(inertia.values())
    digest = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    told = [(j, inertia[j], total, digest(c.values[j])) for j in inertia]
    return found.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
