"""The corpus pipeline: documents to token shards, in stages that each read what the one before has written.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, in order and
unchanged, whatever they are named.

Cases, by stage. Quality: a null or empty text is scored like any other, and stays if the score is high enough. Near duplicates: one row of each
group stays, that of the smallest doc_id; rows with equal doc_ids and unlike texts all stay, as do rows without words or doc_id.
Decontamination: texts without words are clean. Mixing: texts without words are not taken, others as often as at least half of them is.
Tokens: repeated rows are rows of their own; the shards keep the training order. Without labels nothing is rejected; without a benchmark
nothing is contaminated; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm import decontamination, mixing, ngram_join, quality, token_store
from doclens.llm.passes import named
from doclens.llm.queries import quality_model, remainder, tokenizer_path
from doclens.session import materialise, scratch_path

#: Documents that score below this are rejected.
LEAST_QUALITY = 0.3
#: Rows of an Arrow batch, which are whole texts here: batches of 10,000, as Spark has by default, take a tenth of an executor's memory.
BATCH_ROWS = 1000
#: Columns that the operators read; the others pass by under names that no operator gives.
READ = ("doc_id", "text", "source")


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have no more than ``BATCH_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shielded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        plain = docs.select(*(named(c).alias(c if c in READ else f"own_{i}") for i, c in enumerate(docs.columns)))
        return stage(spark, plain, sf_dir).select(*plain.columns).toDF(*docs.columns)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@shielded
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(5) != 0)
    return quality.score(docs, model).where(F.col("score") >= LEAST_QUALITY)


@shielded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


@shielded
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shielded
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it: the files and their rows are in that order."""
    return mixing.training_sequence(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the order of the written rows, read back: a row for each document of the sequence."""
    small_batches(spark)
    path = scratch_path(spark, "tokens")
    token_store.write(docs, path, tokenizer_path(), order=mixing.written_order(docs))
    return token_store.read(spark, path)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed_sources),
    ("token-ID output", tokens),
]

#: The stages' classifiers and encoders are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, "pipeline")
    return docs
