"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target, a share of all words. Its demand over training time t in 0..1 is the integral of a linear
weight schedule, ``target * (a*t + (1-a)*t*t)`` with ``a`` its weight at the start (1: even, under 1: rising, over 1:
falling). The documents of a source stand in hash order; the cumulative words before a document are the demand level
at which it is due, and inverting the integral gives its training position. Beyond one pass over a source the order
repeats. A range sort by position gives the training sequence.

Running totals go in two steps, over hash buckets of a source and inside a bucket, so a source with a third of all rows
is spread over many tasks. Only one row for each source reaches the driver (at most ``MAX_SOURCES``, checked).

Cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, last in the order;
repeated rows are rows of their own, and equal ones may change places; a source without words has target 0; an empty table gives an empty result; other
columns of the input stay, but for those named like a result column, which are replaced.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm.passes import carried, named
from doclens.session import materialise

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Weight at the start of training against the mean, for the same places.
STARTS = (0.5, 1.0, 1.5)
MAX_EPOCHS = 3
#: Rows of a source that one window handles.
BUCKET_ROWS = 2048
MAX_SOURCES = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Shares of all words by weight; a share above ``max_epochs`` times its source stops there and the excess goes to
    the others by weight, until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, capped = float(sum(sizes)), set()
    while True:
        left = total - sum(float(max_epochs * sizes[i]) for i in capped)
        open_weight = sum(w[i] for i in range(len(sizes)) if i not in capped)
        share = [float(max_epochs * s) if i in capped else left * w[i] / open_weight for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in capped and share[i] > max_epochs * s}
        if not over:
            return share
        capped |= over


def position(level: Column, start: Column) -> Column:
    """Training time at which the share ``level`` of a source's demand is met: the inverse of a*t + (1-a)*t*t."""
    bend = 1 - start
    return F.when(F.abs(bend) < 1e-9, level).otherwise((F.sqrt(start * start + 4 * bend * level) - start) / (2 * F.when(F.abs(bend) < 1e-9, 1.0).otherwise(bend))) + F.lit(0.0)


#: Columns that ``mix`` adds.
MADE = ["size", "source_size", "target", "taken", "positions", "first_position"]


def ticket(doc_id: Column, text: Column) -> Column:
    """Place of a document in its source, from 0 to 1; by text too, as rows may share a doc_id or have none."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with size, source_size, target, taken (words, repeats counted), positions (of every pass that takes words
    of the document) and first_position. The last pass over a source ends inside one document. Options: see ``dealt``."""
    kept = carried(docs, None, MADE)
    flat = docs.select(*(named(c).alias(f"c{i}") for i, c in enumerate(kept)), "doc_id", "source", word_count(F.col("text")).alias("size"), ticket(F.col("doc_id"), F.col("text")).alias("ticket"))
    return dealt(flat, **options).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *MADE)


def dealt(sized: DataFrame, weights: tuple = WEIGHTS, starts: tuple = STARTS, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``sized`` (doc_id, source, size, ticket and others, none of them named like a column of MADE or with _ first) with the columns MADE."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    found = per_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.total for r in found], weights, max_epochs)
    plan = [(r.source, r.total, t, float(starts[i % len(starts)]), -(-r.n // bucket_rows)) for i, (r, t) in enumerate(zip(found, goal))]
    table = sized.sparkSession.createDataFrame(plan, "_source string, source_size long, target double, _start double, _buckets long")

    joined = sized.join(table, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_bucket", F.floor(F.col("ticket") * F.col("_buckets")))
    sums = joined.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    passes = F.floor(F.col("target") / F.col("source_size"))
    out = (
        joined.join(before, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_at", at)
        .withColumn("_passes", F.when(F.col("source_size") > 0, F.least(passes, F.lit(max_epochs))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_rest", F.round("target").cast("long") - F.col("_passes") * F.col("source_size"))
        .withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("_rest") - F.col("_at"), F.col("size"))))
        .withColumn("taken", (F.col("_passes") * F.col("size") + F.col("_extra")).cast("long"))
        .withColumn("_times", F.when(F.col("size") > 0, F.col("_passes") + (F.col("_extra") > 0).cast("long")).otherwise(F.lit(0)))
    )
    due = lambda i: position(F.least(F.lit(1.0), (F.col("_at") + (i - 1) * F.col("source_size")) / F.col("target")), F.col("_start"))
    out = out.withColumn("positions", F.when(F.col("_times") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("_times")), due)).otherwise(F.expr("cast(array() as array<double>)")))
    return out.withColumn("first_position", F.get("positions", F.lit(0))).select(*sized.columns, *(m for m in MADE if m != "size"))


def range_sorted(mixed: DataFrame, by: str) -> DataFrame:
    """Rows sorted by position over all partitions, each partition a stretch of training time."""
    return mixed.repartitionByRange(F.col(by).asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col(by).asc_nulls_last(), "doc_id")


def written_order(docs: DataFrame) -> list[Column] | None:
    """Place of a row in a table that was written as files by range: number of the file's part, and row in it. None if ``docs`` are not
    rows of files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return [part, F.col("_metadata.file_name"), F.col("_metadata.row_index")]


def training_sequence(docs: DataFrame, **options) -> DataFrame:
    """Whole documents in training order, a row for each time that the mix takes at least half of a document. Sizes and positions are
    worked out on numbered rows without texts; texts are joined last."""
    number, due = "_row", "_due"
    while number in docs.columns or due in docs.columns:
        number, due = f"_{number}", f"_{due}"
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "mixing-rows")  # a lost task cannot number them anew
    text = F.col("text")
    sized = materialise(rows.select(F.col(number).alias("row"), "doc_id", "source", word_count(text).alias("size"), ticket(F.col("doc_id"), text).alias("ticket")), "mixing-sizes")
    whole = F.round(F.col("taken") / F.col("size")).cast("int")
    times = dealt(sized, **options).where(F.col("size") > 0).select(F.col("row").alias(number), F.explode(F.slice("positions", F.lit(1), whole)).alias(due))
    return range_sorted(rows.join(times, number), due).select(*(named(c) for c in docs.columns))
