"""Documents that arrive in a folder, extracted as they come.

Extraction is a projection over one row, so it runs on a stream as it is: no state, no watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doclens.operators import form, invoice, receipt, resume

SCHEMA = "doc_id long, text string"
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"invoice": invoice.extract, "receipt": receipt.extract, "form": form.extract, "resume": resume.extract}


def arriving(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def extract_stream(spark: SparkSession, landing: str, kind: str, out: str, checkpoint: str):
    """Start a query that writes the records of what has arrived; the checkpoint keeps each file from being read twice."""
    records = EXTRACTORS[kind](arriving(spark, landing))
    return records.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
