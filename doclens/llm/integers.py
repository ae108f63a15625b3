"""Vectors of exact integers from Arrow list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers below this are exact in double precision.
EXACT = 1 << 53


def finite(embedding: str | Column) -> Column:
    """Whether a vector is there, with no null or non-finite component."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(embedding, odd), F.lit(False))


def whole(column: pa.Array, scale: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows, and floor(scale * x) of all components one after the other. Vectors are finite; integers beyond ``most`` are an
    error, as sums of their products would not be exact in 64 bits."""
    if pa.types.is_fixed_size_list(column.type) or pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    values = np.floor(np.asarray(column.flatten().cast(pa.float64())) * scale)
    if len(values) and float(np.abs(values).max()) > most:
        raise ValueError(f"a component times {scale} is beyond {most}: sums of products would not fit in 64 bits")
    return np.concatenate([[0], np.cumsum(lengths)]), values.astype(np.int64)
