"""Toxicity: bags of subword embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its hashed byte n-grams (3 to 5, with word ends marked, and the word as a whole);
a text is the mean of its words; a linear layer and a softmax over two classes follow. Embeddings and layer are trained
jointly in NumPy, by Adam on mini-batches, so a misspelling never seen shares the vectors of its n-grams. The model is
linear in the embeddings: for scoring, each n-gram needs one number only, its embedding times the difference of the
classes' weights, and all n-grams of a buffer are hashed at once.

Learning uses a bounded sample of the labelled rows (``PER_CLASS`` of each class, those of least hash); scoring takes
every text as a whole in one pass without a shuffle.

Cases: a null or empty text, and one without words, gets the score of the bias alone; without labelled rows of both
classes every score is 0.5 or the share of the one class; repeated rows and ties get equal scores; a null doc_id is not
held out; an empty table gives an empty result; other columns stay, but for ``score``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm.passes import carried, map_texts
from doclens.llm.words import _ODD, ALNUM, PLACES, pieces, released, text_bytes, words_of

N_GRAMS = (3, 4, 5)
BUCKET_BITS, DIMENSIONS = 17, 4
#: Rows of each class that the model is fitted on.
PER_CLASS = 2500
STEPS, BATCH, RATE, DECAY = 800, 256, 0.15, 0.02
#: An n-gram whose shares of the two classes' texts differ by fewer standard errors than this keeps a zero vector; from there to
#: twice as many, its steps grow to full length.
EVEN = 4.0
#: n-grams of fewer sample texts than this are left out of the fit.
LEAST_TEXTS = 3


class Grams(NamedTuple):
    bucket: np.ndarray
    word: np.ndarray
    """The word, from 0 in the buffer, that each n-gram is of."""
    counts: np.ndarray
    """Words of each row."""


def grams_of(column: pa.Array) -> Grams:
    """All n-grams of all words of a text column."""
    data, offsets = text_bytes(column)
    words = words_of(data, offsets, ALNUM)
    length = words.end - words.start
    n, total = len(length), int(length.sum()) + 2 * len(length)
    begins = np.cumsum(length + 2) - (length + 2)
    word = np.repeat(np.arange(n), length + 2)
    marked = np.full(total, 0x3C, np.uint8)  # <word>
    inside = np.arange(total) - begins[word]
    within = (inside > 0) & (inside <= length[word])
    marked[within] = data[words.start[word[within]] + inside[within] - 1]
    marked[begins + length + 1] = 0x3E
    left = length[word] + 2 - inside  # bytes from here to the word's end
    shift, buckets, of = np.uint64(64 - BUCKET_BITS), [], []
    sums = np.zeros(total, np.uint64)
    for k in range(1, max(N_GRAMS) + 1):
        sums[: max(0, total - k + 1)] += PLACES[k - 1].take(marked[k - 1 :])
        if k in N_GRAMS:
            at = np.flatnonzero(left >= k)
            buckets.append((sums[at] * np.uint64(_ODD + 2 * k)) >> shift)
            of.append(word[at])
    buckets.append((words.hash * np.uint64(_ODD)) >> shift)
    of.append(np.arange(n))
    return Grams(np.concatenate(buckets).astype(np.int64), np.concatenate(of), words.counts)


class Model(NamedTuple):
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @property
    def gram_scores(self) -> np.ndarray:
        """Log odds of class 1 that each n-gram adds."""
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, odds: float, seed: int = 11) -> Model:
    """``rows``: buckets and weights of each text; ``odds``: of class 1 among all labelled rows."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    embeddings = ((rng.random((size, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    weights, bias = np.tile(np.float32([-0.1, 0.1]), (DIMENSIONS, 1)), np.zeros(2, np.float32)
    n1 = int(labels.sum())
    if n1 in (0, len(labels)):
        bias[1] = 0.0 if not len(labels) else (4.0 if n1 else -4.0)
        return Model(embeddings, weights, bias)
    n0 = len(labels) - n1
    texts, with_1 = (np.bincount(np.concatenate([b for (b, _), y in zip(rows, labels, strict=True) if y in of]), minlength=size) for of in ((0, 1), (1,)))
    both = texts / len(rows)
    uneven = np.abs(with_1 / n1 - (texts - with_1) / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    used = np.flatnonzero((texts >= LEAST_TEXTS) & (uneven > EVEN))
    trust = np.minimum(1, uneven[used] / EVEN - 1).astype(np.float32)[:, None]
    number = np.full(size, -1)
    number[used] = np.arange(len(used))
    rows = [(number[b][k], w[k]) for b, w in rows for k in [number[b] >= 0]]
    params = [embeddings[used], weights, bias]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    params[0] *= trust
    step = 0
    while step < STEPS:
        order = rng.permutation(len(rows))
        for low in range(0, len(rows), BATCH):
            take, step = order[low : low + BATCH], step + 1
            buckets = np.concatenate([rows[i][0] for i in take])
            share = np.concatenate([rows[i][1] for i in take])
            of = np.repeat(np.arange(len(take)), [len(rows[i][0]) for i in take])
            table = params[0]
            hidden = np.stack([np.bincount(of, share * table[buckets, d], len(take)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            logits = hidden @ weights + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(take)), labels[take]] -= 1
            p /= len(take)
            back = p @ weights.T
            own = np.stack([np.bincount(buckets, share * back[of, d], len(used)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            rate = RATE * max(0.02, 1 - step / STEPS)
            for param, grad, (m, v), part in zip(params, (own, hidden.T @ p, p.sum(0)), state, (trust, 1.0, 1.0), strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= rate * part * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            params[0] *= 1 - DECAY * rate
    table = params[0]
    embeddings[:] = 0
    embeddings[used] = table
    bias[1] += np.log(odds) - np.log(n1 / n0)  # the classes' shares in the sample are not those of all rows
    return Model(embeddings, weights, bias)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        grams = grams_of(piece.column("text"))
        row_of_word = np.repeat(np.arange(piece.num_rows), grams.counts)
        share = 1.0 / np.bincount(grams.word, minlength=len(row_of_word)) / np.repeat(np.maximum(1, grams.counts), grams.counts)
        key = row_of_word[grams.word] << BUCKET_BITS | grams.bucket
        distinct, which = np.unique(key, return_inverse=True)
        weight = np.bincount(which, share[grams.word], len(distinct)).astype(np.float32)
        cut = pa.array(np.searchsorted(distinct >> BUCKET_BITS, np.arange(piece.num_rows + 1)), pa.int32())
        bucket = pa.array((distinct & ((1 << BUCKET_BITS) - 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([piece.column("label").cast(pa.int32()), pa.ListArray.from_arrays(cut, bucket), pa.ListArray.from_arrays(cut, pa.array(weight))], ["label", "buckets", "weights"])


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = PER_CLASS) -> Model:
    """Fit on the rows of ``labels`` for which ``learn`` holds: the ``per_class`` rows of least hash in each class."""
    own = labels.where(learn & F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).distinct()
    n = {r.label: r["count"] for r in own.groupBy("label").count().collect()}
    some = [own.where(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for k in (0, 1)]
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(some[0].union(some[1])), F.col("doc_id") == F.col("_id"))
    found = sample.select("text", "label").mapInArrow(released(_sparse), "label int, buckets array<int>, weights array<float>").toArrow()
    lists = [[np.asarray(x.values) for x in found[c].combine_chunks()] if found.num_rows else [] for c in ("buckets", "weights")]
    y = found["label"].to_numpy().astype(int) if found.num_rows else np.zeros(0, int)
    keep = [i for i, b in enumerate(lists[0]) if len(b)]
    return fit([(lists[0][i], lists[1][i]) for i in keep], y[keep], n.get(1, 0) / max(1, n.get(0, 0)) or 1.0)


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns of ``docs`` by default) and ``score``, the probability of class 1."""
    sent = docs.sparkSession.sparkContext.broadcast((model.gram_scores.astype(np.float32), float(model.bias[1] - model.bias[0])))

    def scored(texts: pa.Array) -> list:
        gram_scores, bias = sent.value
        grams = grams_of(texts)
        n_words = int(grams.counts.sum())
        of_words = np.bincount(grams.word, gram_scores[grams.bucket], n_words) / np.bincount(grams.word, minlength=n_words)
        of_texts = np.bincount(np.repeat(np.arange(len(texts)), grams.counts), of_words, len(texts)) / np.maximum(1, grams.counts)
        return [1 / (1 + np.exp(-np.clip(of_texts + bias, -30, 30)))]

    return map_texts(docs, carried(docs, carry, ["score"]), "text", scored, "score double")
