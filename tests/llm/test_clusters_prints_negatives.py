"""Clusters, fingerprints and hard negatives against brute force, and their edge cases."""

import hashlib
import math
import re

import numpy as np
import pytest
import xxhash

from doclens.llm import clusters, hard_negatives, simhash

INF, NAN = float("inf"), float("nan")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' AS cluster", "1 AS score", "2 AS row_id", "3 AS `a.b`")


def usable(v, d=None):
    return v is not None and (d is None or len(v) == d) and all(x is not None and math.isfinite(x) for x in v)


# Clusters


def brute_clusters(rows, k, rounds, d):
    rows = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], v) for i, v, _ in rows if usable(v, d)]
    ticket = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2])
    c = [list(r[1]) for r in sorted(rows, key=ticket)[:k]]
    away = lambda v, j: sum((a - b) ** 2 for a, b in zip(v, c[j], strict=True))
    near = lambda: [min(range(len(c)), key=lambda j: (away(v, j), j)) for _, v, _ in rows]
    for _ in range(rounds):
        a = near()
        for j in range(len(c)):
            own = [r[1] for r, n in zip(rows, a, strict=True) if n == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    a = near()
    gone = [away(r[1], n) for r, n in zip(rows, a, strict=True)]
    sums = [sum(g for g, n in zip(gone, a, strict=True) if n == j) for j in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(r[0], n, g, sums[n], sum(gone), digest[n]) for r, n, g in zip(rows, a, gone, strict=True)]


def of_clusters(df):
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k,d,spread,scale", [(8, 4, 1.0, 1.0), (5, 3, 0.0, 1.0), (1, 2, 1.0, 1.0), (6, 2, 0.3, 3000.0), (40, 2, 0.2, 1.0)])
def test_clusters(spark, monkeypatch, k, d, spread, scale):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 37)
    monkeypatch.setattr(clusters, "BUCKET_BLOCKS", 2)
    rng = np.random.default_rng(k)
    centres = rng.integers(-3, 4, (6, d)) / 4
    rows = [(int(i), [float(np.float32(x * scale)) for x in centres[rng.integers(6)] + spread * rng.normal(size=d).round(2) * 0.2], 0) for i in range(200)]
    rows += [(7, rows[8][1], 0), (7, rows[9][1], 0), (None, [0.5] * d, 0), (None, None, 0), (400, [0.0] * d, 0), (401, [NAN] * d, 0), (402, [INF] * d, 0), (403, [None] * d, 0), (404, [1.0] * (d + 1), 0), (405, [], 0)]
    found = clusters.cluster(vectors(spark, rows), k=k, rounds=3, dimensions=d)
    assert of_clusters(found) == sorted(brute_clusters(rows, k, 3, d), key=repr)


def test_clusters_of_few_or_no_vectors(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(3)]
    assert of_clusters(clusters.cluster(vectors(spark, rows), rounds=2, dimensions=2)) == sorted(brute_clusters(rows, 8, 2, 2), key=repr)
    assert clusters.cluster(vectors(spark, rows)).count() == 0  # other lengths
    with pytest.raises(Exception, match="64 bits"):
        clusters.cluster(vectors(spark, [(1, [3e38, 1.0], 0)]), dimensions=2).count()


def test_exponion_looks_at_few_centroids(monkeypatch):
    """On clustered vectors most are settled by bounds, and the others by part of the centroids."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (64, 4))
    x = (centres[rng.integers(64, size=4000)] + rng.integers(-60, 60, (4000, 4))).astype(np.int64)
    c = clusters.Centroids.of(centres.astype(np.int64))
    state = clusters.scanned(x, np.arange(64), c)
    looked = []
    plain = clusters.squares
    monkeypatch.setattr(clusters, "squares", lambda a, b: looked.append(len(a) * len(b)) or plain(a, b))
    for _ in range(4):
        values = np.array([x[state.near == j].sum(0) // max(1, (state.near == j).sum()) for j in range(64)])
        c = clusters.Centroids.of(values, c.values)
        looked.clear()
        state = clusters.reassigned(x, state, c)
        assert (state.near == plain(x, values).argmin(1)).all()
        assert sum(looked) < 4000 * 64 / 8


# Fingerprints


def brute_print(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius=2):
    """Smallest place reachable from each."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def texts():
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 400)) for _ in range(4)]
    out = [None, "", " \t\n", "One", "one", "one TWO", "É x y", "é x y", "a\x1cb c d", "a b c d e"]
    for b in base:
        words = b.split()
        for _ in range(30):
            copy = list(words)
            copy[int(rng.integers(len(copy)))] = "changed"
            out.append(" ".join(copy))
        out += [b, b.upper(), b + "\n"]
    return out


@pytest.mark.parametrize("large,small", [(4096, 32), (3, 2), (3, 32)])
def test_simhash(spark, monkeypatch, large, small):
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "STRETCH", 50)
    rows = [(1000 - i, t) for i, t in enumerate(texts())] + [(None, "one"), (None, "alone in all this")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS fp", "1 AS bucket")
    prints = [brute_print(t) for _, t in rows]
    group = brute_groups(prints)
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    want = sorted(((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group, strict=True)), key=repr)
    got = simhash.components(docs)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=repr) == want
    assert len(set(group)) < len(set(prints))  # near copies are linked
    assert simhash.components(docs.where("false")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_links(radius):
    """Both ways of comparing give the groups that all pairs give, in buckets of any size."""
    rng = np.random.default_rng(radius)
    prints = []
    for n in (1, 2, 31, 32, 33, 64, 65, 1500):
        seed = rng.integers(0, 2**63, 1 + n // 8, dtype=np.uint64)
        own = seed[rng.integers(len(seed), size=n)]
        for _ in range(3):
            own ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
        prints.append(np.unique(own))
    for own in prints:
        for links in [simhash.large_links(own, radius)] + ([simhash.small_links(own, np.zeros(len(own), np.int64), np.full(len(own), len(own)), radius)] if len(own) <= 32 else []):
            place = {int(p): i for i, p in enumerate(own)}
            group = list(range(len(own)))
            for a, b in zip(*links.tolist(), strict=True):
                x, y = sorted((group[place[a]], group[place[b]]))
                group = [x if g == y else g for g in group]
            if len(own) < 100:
                assert group == brute_groups(own.tolist(), radius)
            else:
                away = np.bitwise_count(own[:, None] ^ own) <= radius
                reach = np.arange(len(own))
                while True:
                    new = np.array([reach[row].min() for row in away])
                    if (new == reach).all():
                        break
                    reach = new
                assert group == reach.tolist()
    places = np.concatenate(prints[:4])
    opens = np.repeat(np.cumsum([0, *map(len, prints[:3])]), list(map(len, prints[:4])))
    size = np.repeat(list(map(len, prints[:4])), list(map(len, prints[:4])))
    found = {tuple(sorted(p)) for p in zip(*simhash.small_links(places, opens, size, radius).tolist(), strict=True)}
    want = {tuple(sorted((int(x), int(y)))) for own in prints[:4] for i, x in enumerate(own) for y in own[:i] if int(x ^ y).bit_count() <= radius}
    assert found == want


def test_long_text_is_hashed_whole():
    rng = np.random.default_rng(2)
    text = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 150_000))
    h = np.concatenate(list(simhash.hashes(text.encode())))
    words = text.split()
    assert len(h) == len(words) - 2 and h[-1] == xxhash.xxh64_intdigest(" ".join(words[-3:]).encode(), 42)
    assert h[simhash.STRETCH - 1 :][:2].tolist() == [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in (simhash.STRETCH - 1, simhash.STRETCH)]


# Hard negatives


def brute_negatives(rows, every):
    kept = [(n, i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and usable(v)]
    out = []
    for n, i, lab, v in kept:
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for m, j, other, w in kept if m != n and len(w) == len(v)]
        for s, p, _ in sorted(x for x in score if x[2] == lab)[:5]:
            fits = sorted((t, j) for t, j, other in score if other != lab and 80 * -s <= 100 * -t <= 100 * -s)
            out += [(i, p, rank, j, -s, -t) for rank, (t, j) in enumerate(fits[:5], 1)]
    return sorted(out)


def label(F):
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("d,labels,scale,slice_,block", [(8, 3, 1.0, 65_536, 16_384), (4, 10, 0.02, 40, 3), (64, 4, 1.0, 100, 7), (3, 2, 60_000.0, 50, 5), (2, 1, 1.0, 65_536, 16_384)])
def test_hard_negatives(spark, monkeypatch, d, labels, scale, slice_, block):
    from pyspark.sql import functions as F

    monkeypatch.setattr(hard_negatives, "SLICE_ROWS", slice_)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    rng = np.random.default_rng(d)
    rows = [(int(i), (rng.normal(size=d) * scale).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(260)]
    rows += [(100, rows[3][1], rows[3][2]), (100, rows[100][1], rows[100][2]), (55, rows[56][1], 1)]  # repeated ids and vectors
    rows += [(300, None, 1), (310, [NAN] * d, 1), (320, [None] * d, 1), (330, [1.0] * d, None), (None, [1.0] * d, 1), (400, [0.0] * d, 1), (500, [1.0] * (d + 1), 0), (501, [1.0] * (d + 1), 0), (502, [1.0] * (d + 1), 1), (600, [], 1), (603, [], 1), (604, [], 2)]
    found = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, label(F))
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())
    assert got == brute_negatives(rows, 10) and got


def test_hard_negatives_of_nothing(spark):
    from pyspark.sql import functions as F

    rows = vectors(spark, [(1, [1.0], 1), (2, [2.0], 2)])
    assert hard_negatives.mine(rows, F.col("vec_id") == 1).count() == 0  # no positives
    assert hard_negatives.mine(rows.where("false"), F.lit(True)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(vectors(spark, [(1, [3e38], 1)]), F.lit(True)).count()


def test_planes_drop_most_pairs_early(monkeypatch):
    """On unit vectors few pairs are left when the last plane is added, and what is left is right."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2048, 64))
    x = np.floor(256 * x / np.sqrt((x * x).sum(1))[:, None]).astype(np.int64)
    a, left = x[:64], []
    test = hard_negatives.Best(np.full(64, hard_negatives.NOTHING), 5)
    passes = test.passes
    monkeypatch.setattr(test, "passes", lambda i, low, high: left.append(len(i)) or passes(i, low, high))
    i, j, score = hard_negatives.sliced(a, hard_negatives.Tile(x), np.ones((64, 2048), bool), test)
    assert (score == (a[i] * x[j]).sum(1)).all()
    best = np.sort(a @ x.T, axis=1)[:, -5:]
    assert all(set(best[n]) <= set(score[i == n]) for n in range(64))
    assert left and left[-1] < 64 * 2048 / 50


@pytest.mark.parametrize("name", ["op11_clusters", "op13_hard_negatives"])
def test_same_rows_as_sql(spark, sf, name):
    import duckdb

    from doclens.llm import queries

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
