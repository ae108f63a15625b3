"""The table of stored documents, analytics over it, classification metrics, and splits of labelled data."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.functions.extract import json_first
from doclens.functions.predicates import truthy
from doclens.functions.text import title_type
from doclens.operators.numbering import numbered
from doclens.session import exists
from doclens.sources.writers import append_documents

TYPES = ["resume", "invoice", "receipt", "form"]
#: Epochs of a run that one window handles.
STRETCH = 1024


STORED = "id long, file_name string, document_type string, confidence double, raw_text string, json_data string"


def stored(docs: DataFrame, payload: Column, file_name: Column, document_type: Column, confidence: Column, raw_text: Column, first_id: int = 1) -> DataFrame:
    """Rows of the store, ids from ``first_id`` on in the order of ``docs``, without gaps. The payload is kept as JSON; a document without a
    confidence has that of the payload's statistics, and one that is no number counts as 0; without a text it is empty."""
    rows = docs.select(file_name.alias("file_name"), document_type.alias("document_type"), confidence.cast("string").alias("given"), raw_text.alias("raw_text"), F.to_json(payload).alias("json_data"))
    own = F.coalesce("given", F.get_json_object("json_data", "$.statistics.confidence")).try_cast("double")
    rows = rows.select("file_name", "document_type", F.coalesce(own, F.lit(0.0)).alias("confidence"), F.coalesce("raw_text", F.lit("")).alias("raw_text"), "json_data")
    return numbered(rows, "id", first_id).select("id", *rows.columns)


def insert(docs: DataFrame, path: str, payload: Column, file_name: Column, document_type: Column, confidence: Column, raw_text: Column) -> DataFrame:
    """Append documents to the store at ``path`` (made if absent) and return their rows. Ids go on from the largest that is stored. One writer
    at a time."""
    spark = docs.sparkSession
    last = spark.read.schema(STORED).parquet(path).agg(F.max("id")).first()[0] if exists(spark, path) else None
    rows = stored(docs, payload, file_name, document_type, confidence, raw_text, (last or 0) + 1)
    append_documents(rows, path)
    return rows


def delete(spark: SparkSession, path: str, id_: int) -> bool:
    """Whether the store at ``path`` held a document of that id, which is then gone. Only files that hold it are written anew, without it; the
    footers' least and greatest ids tell which others need not be opened. The new file has a name that its old one and the id set, and comes
    before the old one goes: a delete that was cut short between the two loses nothing and is ended by another."""
    store = spark.read.schema(STORED).parquet(path)
    held = store.where(F.col("id") == id_).select(F.col("_metadata.file_path").alias("file")).distinct().collect()  # files of one id
    jvm = spark._jvm
    for row in held:
        old = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["file"]))
        files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stem = re.sub(r"(-without-[0-9a-f]{12})?(\.snappy)?\.parquet$", "", old.getName())
        new = jvm.org.apache.hadoop.fs.Path(old.getParent(), f"{stem}-without-{hashlib.sha256(f'{old.getName()} {id_}'.encode()).hexdigest()[:12]}.parquet")
        if not files.exists(new):
            aside = jvm.org.apache.hadoop.fs.Path(old.getParent(), f"_{uuid.uuid4().hex}")  # readers pass over names with _ first
            spark.read.parquet(old.toString()).where(F.col("id") != id_).coalesce(1).write.parquet(aside.toString())
            part = next(f.getPath() for f in files.listStatus(aside) if f.getPath().getName().startswith("part-"))
            files.rename(part, new)
            files.delete(aside, True)
        files.delete(old, False)
    return bool(held)


def get(store: DataFrame, id_: int) -> DataFrame:
    return store.where(F.col("id") == id_).limit(1)


def latest(store: DataFrame, n: int | None = None) -> DataFrame:
    rows = store.orderBy(F.desc("id"))
    return rows if n is None else rows.limit(n)


def of_type(store: DataFrame, document_type: str) -> DataFrame:
    return store.where(F.col("document_type") == document_type).orderBy(F.desc("id"))


def without(store: DataFrame, id_: int) -> DataFrame:
    return store.where(F.col("id") != id_)


def records(store: DataFrame) -> DataFrame:
    """The analytics frame: type, confidence, completion, validation and review of each stored document."""
    j = F.try_parse_json("json_data")
    number = lambda c: F.replace(F.trim(c), F.lit("%"), F.lit("")).try_cast("double")
    kind = F.coalesce(F.nullif("document_type", F.lit("")), json_first(j, ["document_type", "type"]), F.lit("unknown"))
    return store.select(
        "id", "file_name", title_type(kind).alias("type"), F.coalesce("confidence", number(json_first(j, ["confidence"]))).alias("confidence"),
        number(json_first(j, ["completion_score", "completion"])).alias("completion"), number(json_first(j, ["validation_score", "validation"])).alias("validation"),
        F.coalesce(truthy(json_first(j, ["needs_review", "human_review", "requires_review"])), F.lit(False)).alias("needs_review"),
    )


def kpis(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("documents"), F.avg("confidence").alias("confidence"), F.avg("completion").alias("completion"), F.avg("validation").alias("validation"),
        F.coalesce(F.sum(F.col("needs_review").cast("long")), F.lit(0)).alias("reviews"), *[F.count_if(F.lower("type") == t).alias(t) for t in TYPES],
    )


def by_type(rows: DataFrame) -> DataFrame:
    means = [F.round(F.avg(c), 1).alias(c) for c in ("confidence", "completion", "validation")]
    return rows.groupBy("type").agg(F.count("*").alias("documents"), *means, F.sum(F.col("needs_review").cast("long")).alias("reviews"))


def overall_quality(rows: DataFrame) -> DataFrame:
    means = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("confidence", "completion", "validation")])
    return means.unpivot([], ["confidence", "completion", "validation"], "metric", "score")


def class_report(pairs: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support of each class; a ratio over nothing is 0."""
    each = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(guess).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), (F.col(truth) == F.col(guess)).cast("int").alias("hit"))
    sums = each.groupBy("s.label").agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("guessed"), (F.sum("hit") / 2).alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("hits"), F.col("guessed")), ratio(F.col("hits"), F.col("support"))
    return sums.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def full_report(pairs: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """place, label, precision, recall, f1 and support: a row for each class in order, then accuracy (as f1, as it has no others), macro and weighted means.

    Pairs are summed to a row for each class; class rows and means come from grouping these by class and as a whole in one aggregation.
    """
    own = class_report(pairs, truth, guess).withColumn("label", F.col("label").cast("string"))
    mean = lambda c: F.avg(c).alias(f"macro_{c}")
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"weighted_{c}")
    scores = ["precision", "recall", "f1"]
    sums = own.groupingSets([["label"], []], "label").agg(F.grouping("label").alias("whole"), *map(mean, scores), *map(weighted, scores), F.sum("support").alias("support"))
    none = F.lit(None).cast("double")
    row = lambda place, label, values: F.struct(F.lit(place).alias("place"), label.alias("label"), *(v.alias(c) for v, c in zip(values, scores, strict=True)), F.col("support"))
    macro, means = [F.col(f"macro_{c}") for c in scores], [F.col(f"weighted_{c}") for c in scores]
    told = F.when(F.col("whole") == 0, F.array(row(0, F.col("label"), macro))).otherwise(
        F.array(row(1, F.lit("accuracy"), [none, none, means[1]]), row(2, F.lit("macro avg"), macro), row(3, F.lit("weighted avg"), means))
    )
    return sums.where("support is not null").select(F.explode(told).alias("r")).select("r.*")


def best_epochs(epochs: DataFrame, run: str = "run", epoch: str = "epoch", score: str = "score", patience: int = 5) -> DataFrame:
    """``epochs`` up to where each run stops, with ``best`` (the greatest score so far), ``improved`` (strictly above all before), ``since`` (epochs
    since the best one) and ``stops`` (``patience`` epochs without a better one: the last that is kept).

    Running maxima go over stretches of epochs first and inside them then, so no window holds more than a stretch of ``STRETCH`` numbers.
    Scores that are null do not improve; the first score does. Epochs are whole numbers, different in a run.
    """
    rows = epochs.withColumn("_stretch", F.floor(F.col(epoch) / STRETCH))
    key = [run, "_stretch"]
    inside, before = Window.partitionBy(*key).orderBy(epoch), Window.partitionBy(run).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    greatest = rows.groupBy(*key).agg(F.max(score).alias("_most"), F.count("*").alias("_n"))
    carried = greatest.select(*key, F.max("_most").over(before).alias("_most"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    rows = rows.join(carried, key)  # runs are not null
    so_far = F.greatest("_most", F.max(score).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("improved", F.coalesce(F.col(score) > so_far, F.col(score).isNotNull() & so_far.isNull()))
    rows = rows.withColumn("_place", F.col("_ahead") + F.row_number().over(inside)).withColumn("best", F.greatest(so_far, F.col(score)))
    own = F.when(F.col("improved"), F.col("_place"))
    marks = rows.groupBy(*key).agg(F.max(own).alias("_mark")).select(*key, F.max("_mark").over(before).alias("_mark"))
    last = F.coalesce(F.max(own).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_mark"), F.lit(0))
    rows = rows.join(marks, key).withColumn("since", F.col("_place") - last).withColumn("stops", F.col("since") == patience)
    ends = rows.where("stops").groupBy(F.col(run).alias("_run")).agg(F.min(epoch).alias("_end"))
    kept = rows.join(ends, F.col(run) == F.col("_run"), "left").where(F.col("_end").isNull() | (F.col(epoch) <= F.col("_end")))
    return kept.select(*epochs.columns, "best", "improved", "since", "stops")


def dataset(sources: dict[str, DataFrame], content: str) -> DataFrame:
    """Rows of all sources, ``source`` naming theirs; columns that a source lacks are null. Of rows of equal content (text or bytes) one stays: that of the
    source named first, and of its rows the first by their other columns. Rows without content all stay.

    Rows meet by a digest of their content, with counts of one row for each digest made before they are sent, so content with very many copies costs no more.
    """
    every = None
    for rank, (name, rows) in enumerate(sources.items()):
        own = rows.withColumn("source", F.lit(name)).withColumn("_rank", F.lit(rank))
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    columns = [c for c in every.columns if c != "_rank"]
    whole = F.struct(*columns)
    told = every.select(F.sha2(F.col(content).cast("binary"), 256).alias("digest"), "_rank", F.xxhash64(F.to_json(whole)).alias("ticket"), whole.alias("row"))
    first = told.where("digest is not null").groupBy("digest").agg(F.min_by("row", F.struct("_rank", "ticket")).alias("row"))
    return first.select("row.*").union(told.where("digest is null").select("row.*"))


def weighted_scores(pairs: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    report = class_report(pairs, truth, guess)
    share = F.sum("support")
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / share).alias(c)
    accuracy = (F.sum(F.col("recall") * F.col("support")) / share).alias("accuracy")
    return report.agg(accuracy, mean("precision"), mean("recall"), mean("f1"), share.alias("support"))


def confusion_matrix(pairs: DataFrame, classes: list, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    return pairs.groupBy(truth).pivot(guess, classes).count().na.fill(0).withColumnsRenamed({str(c): f"pred_{c}" for c in classes})


def stratified_split(rows: DataFrame, label: str, key: str, train: int = 70, valid: int = 15) -> DataFrame:
    """Exact shares of each class, in the order of a portable hash of the key. A class of any size is numbered by counts of hash
    buckets first, so no window holds more than a bucket."""
    hashed = rows.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(label))).drop("_n")
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) + F.col("_before")
    numbered = hashed.join(totals, [label, "_b"]).withColumn("_place", place)
    first, second = F.floor(F.col("_all") * train / 100), F.floor(F.col("_all") * valid / 100)
    split = F.when(F.col("_place") <= first, "train").when(F.col("_place") <= first + second, "valid").otherwise("test")
    return numbered.withColumn("split", split).select(*rows.columns, "split")


def encode_labels(rows: DataFrame, label: str) -> DataFrame:
    """Labels with their place (from 0) in sorted order; labels are few, the rows many."""
    names = rows.select(label).where(F.col(label).isNotNull()).distinct()
    coded = names.withColumn("label_index", F.dense_rank().over(Window.orderBy(label)) - 1)
    return rows.join(coded, label, "left")
