"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text are enough: the non-negative unbiased risk is
``prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])``, and where the bracket falls below zero the step
goes up that part instead. The class prior is estimated first, from a plain positive-against-unlabelled classifier: the
least ratio, over thresholds, of the unlabelled share above to the positive share above, counted over all documents. Model: one hidden layer over
counted features of the whole text (kinds of bytes, shapes of words, repeats), trained by Adam in NumPy.

The fit uses bounded samples (those of least hash): half of ``SAMPLE`` of the labelled positives and half of all documents, which
are the unlabelled text whatever labels they have. The prior's thresholds are counted by a histogram over all documents, but for
those that its classifier was fitted on; ids and bins alone are shuffled. Scoring takes every text as a whole in one pass without a
shuffle. Labels of class 0 are not used.

Cases: a null or empty text has all features 0 and is scored as such; without positives the
score is 0.5; repeated rows and ties get equal scores; an empty table gives an empty result; other columns stay, but for
``score``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm.passes import carried, map_texts
from doclens.llm.words import NOT_SPACE, pieces, released, spans_hash, text_bytes, words_of

#: Rows whose features the fit is made on, half of them positives.
SAMPLE = 24_000
HIDDEN, EPOCHS, BATCH, RATE = 16, 40, 512, 0.01

_KINDS = ["upper", "lower", "digit", "high", "space", "newline", "stop", "other"]
_KIND = np.full(256, 7, np.int64)
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 3
_KIND[[0x20, 0x09]], _KIND[[0x0A, 0x0D]] = 4, 5
_KIND[[ord(c) for c in ".,;:'-"]] = 6
#: Marks that are counted each on its own.
MARKS = "!?|*&%$#@=+/<>{}[]()_~^\\\""
FEATURES = [*_KINDS, *MARKS, "log words", "word length", "long words", "capital words", "marked words", "repeats next", "repeats second", "distinct words", "distinct triples", "distinct fives", "line words"]


def features_of(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(1, np.diff(offsets))
    counts = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    kinds = np.stack([counts[:, _KIND == k].sum(1) for k in range(len(_KINDS))], 1)
    marks = counts[:, [ord(c) for c in MARKS]]
    words = words_of(data, offsets, NOT_SPACE)
    of, length = words.row, words.end - words.start
    n_words = np.maximum(1, words.counts)
    per_word = lambda x: np.bincount(of, x, n) / n_words
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    upper, letters, other = (sums(x) for x in ((_KIND[data] == 0), (_KIND[data] <= 1), (_KIND[data] == 7)))
    within = lambda s: s[words.end] - s[words.start]
    capital = (within(upper) >= 2) & (within(upper) == within(letters))
    same = [np.concatenate([(words.hash[k:] == words.hash[:-k]) & (of[k:] == of[:-k]), np.zeros(min(k, len(of)), bool)]) if len(of) > k else np.zeros(len(of), bool) for k in (1, 2)]

    def distinct(k: int) -> np.ndarray:
        h = spans_hash(words.hash, k)
        if not len(h):
            return np.ones(n)
        at = of[: len(h)] == of[k - 1 : k - 1 + len(h)]
        o, h = of[: len(h)][at], h[at]
        order = np.lexsort((h, o))
        o, h = o[order], h[order]
        new = np.ones(len(o), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        total = np.bincount(o, minlength=n)
        return np.where(total > 0, np.bincount(o, new, n) / np.maximum(1, total), 1.0)

    lines = counts[:, 0x0A] + 1
    extra = [np.log1p(words.counts), per_word(length) / 10, per_word(length > 15), per_word(capital), per_word(within(other) > 0), per_word(same[0]), per_word(same[1]), distinct(1), distinct(3), distinct(5), np.log1p(words.counts / lines)]
    out = np.concatenate([np.sqrt(kinds / size[:, None]), np.sqrt(marks / size[:, None]), np.stack(extra, 1)], 1)
    out[words.counts == 0] = 0
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.layers, (x - self.mean) / self.scale)[1] if self.layers else np.zeros(len(x))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, hidden @ layers[2] + layers[3][0]


def _adam(layers: list[np.ndarray], batches, gradient) -> None:
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
    for step, (x, tag) in enumerate(batches, 1):
        hidden, g = _forward(layers, x)
        slope = gradient(g, tag)
        back = np.outer(slope, layers[2]) * (1 - hidden * hidden)
        grads = (x.T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ slope + 1e-4 * layers[2], np.array([slope.sum()]))
        for p, d, (m, v) in zip(layers, grads, state, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, back: tuple[np.ndarray, np.ndarray], above, seed: int = 5) -> Model:
    """``back`` are the rows of each held back from the first classifier, ``above(model, cuts)`` counts for ``class_prior``."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), [], 0.5)
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    new = lambda: [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def batches(epochs: int, own: list[np.ndarray]):
        """Pairs of positive and unlabelled rows, as many of each."""
        for _ in range(epochs * -(-len(own[1]) // BATCH)):
            yield np.concatenate([x[rng.integers(0, len(x), BATCH)] for x in own]), BATCH

    def plain(g: np.ndarray, n: int) -> np.ndarray:
        s = _sigmoid(g)
        s[:n] -= 1
        return s / len(g)

    layers = new()
    _adam(layers, batches(EPOCHS // 4, [x[~b] if not b.all() else x for x, b in zip((p, u), back, strict=True)]), plain)
    scores = _forward(layers, p[back[0]] if back[0].any() else p)[1]
    prior = class_prior(*above(Model(mean, scale, layers, 0.5), np.quantile(scores, np.linspace(0, 0.9, 91))))

    def non_negative(g: np.ndarray, n: int) -> np.ndarray:
        s, out = _sigmoid(g), np.zeros_like(g)
        loss_minus = np.logaddexp(0, g)  # of calling a row negative
        if loss_minus[n:].mean() - prior * loss_minus[:n].mean() >= 0:
            out[:n] = prior * (s[:n] - 1) / n - prior * s[:n] / n
            out[n:] = s[n:] / n
        else:  # less than a negative class can cost: go up that part
            out[:n] = prior * s[:n] / n
            out[n:] = -s[n:] / n
        return out

    layers = new()
    _adam(layers, batches(EPOCHS, [p, u]), non_negative)
    return Model(mean, scale, layers, prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.05) -> float:
    """Share of positives among the unlabelled: the least upper bound on it over thresholds. Given are how many rows score at
    least each threshold, and last how many there are."""
    p, u = positive[:-1] / max(1, positive[-1]), unlabelled[:-1] / max(1, unlabelled[-1])
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(max(1, unlabelled[-1])) + 1 / np.sqrt(max(1, positive[-1])))
    best = int(np.argmin((u + slack) / np.maximum(1e-9, p)))
    return float(np.clip(u[best] / max(1e-9, p[best]), 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE) -> Model:
    """Positives are the rows of ``labels`` with class 1 for which ``learn`` holds; all documents are the unlabelled text, their
    labels unread."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = labels.where(learn & (F.col(label) == 1)).select("doc_id").distinct()
    positives = docs.select("doc_id").join(own, "doc_id", "left_semi")
    ticket = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 11) / F.lit(float(1 << 53))
    half = sample / 2
    good, some = ((ticket < min(1.0, half / max(1, df.count()))) for df in (positives, docs))
    back = F.xxhash64(F.lit(7), "doc_id").bitwiseAND(F.lit(1)) == 0
    picked = F.broadcast(positives.where(good).distinct().withColumn("good", F.lit(True)))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_bytes")).join(picked, "doc_id", "left").where(F.col("good") | some)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_bytes"):
            x = features_of(piece.column("_bytes"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "good", "some", "back")), lists], ["doc_id", "good", "some", "back", "x"])

    flags = [F.coalesce("good", F.lit(False)).alias("good"), some.alias("some"), back.alias("back")]
    made = rows.select("doc_id", *flags, "_bytes").mapInArrow(released(counted), f"doc_id {kind}, good boolean, some boolean, back boolean, x array<double>")
    # rows that share a doc_id are picked together, so their number is bounded once more
    known = made.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(2 * sample).toArrow()
    x = np.asarray(known["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES)) if known.num_rows else np.zeros((0, len(FEATURES)))
    is_good, is_some, is_back = (np.asarray(known[c].combine_chunks().to_numpy(zero_copy_only=False), bool) for c in ("good", "some", "back"))

    def above(model: Model, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "_bytes"):
                bins = np.searchsorted(cuts, model.logits(features_of(piece.column("_bytes"))), "right")
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(bins.astype(np.int32))], ["doc_id", "bin"])

        bins = docs.select("doc_id", F.col("text").cast("binary").alias("_bytes")).mapInArrow(released(binned), f"doc_id {kind}, bin int")
        flagged = bins.join(own.withColumn("good", F.lit(True)), "doc_id", "left")
        count = lambda test: F.count(F.when(test, 1))
        found = flagged.groupBy("bin").agg(count(F.col("good") & (back | ~good)).alias("p"), count(back | ~some).alias("u"), count(F.col("good")).alias("every_p"), F.count("*").alias("every_u")).collect()
        out = []
        for c in ("p", "u"):
            c = c if any(r[c] for r in found) else f"every_{c}"
            counts = np.zeros(len(cuts) + 1)
            for r in found:
                counts[r.bin] = r[c]
            out.append(np.append(counts[::-1].cumsum()[::-1][1:], counts.sum()))
        return tuple(out)

    return fit(x[is_good], x[is_some], (is_back[is_good], is_back[is_some]), above)


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns of ``docs`` by default) and ``score``, the probability of good quality."""
    return map_texts(docs, carried(docs, carry, ["score"]), "text", lambda texts: [_sigmoid(model.logits(features_of(texts)))], "score double")
