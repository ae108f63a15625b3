"""Registry of the library's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doclens.operators import invoice
from doclens.plans import queries as registered
from doclens.plans import rendered


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All invoices rendered from the orders, read back with every field and their items."""
    return invoice.extract(rendered.invoices(spark, sf_dir)).drop("text")
