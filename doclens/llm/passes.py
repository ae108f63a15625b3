"""Passes over a text column that carry other columns along.

Columns travel under numbered names, whatever their own are (with dots, or like a column of the pass), and the text is sent to
Python once, also where it is carried itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.words import pieces, released

TEXT = "text"


def named(name: str) -> Column:
    """A column by its very name."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, carry: list[str] | None, made: list[str]) -> list[str]:
    """``carry`` (all columns by default) but for those named like a column that a pass makes."""
    names = {m.lower() for m in made}
    return [c for c in (df.columns if carry is None else carry) if c.lower() not in names]


def map_rows(df: DataFrame, carry: list[str], text: str, run: Callable[[Iterator[pa.RecordBatch], str, pa.Schema], Iterator[pa.RecordBatch]], made: T.StructType, read: list[str] | None = None) -> DataFrame:
    """``carry`` and the columns ``made``. ``run`` gets batches, the name of their text column and the schema of what it yields: the
    carried columns as they came in, c0 on, then ``made``, m0 on. Columns ``read`` are sent only, as r0 on."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [df.schema[c].dataType for c in carry]
    inside = [named(c).alias(f"c{i}") for i, c in enumerate(carry)]
    inside += [named(c).alias(f"r{i}") for i, c in enumerate(read or [])]
    if text in carry and kinds[carry.index(text)] in (T.StringType(), T.BinaryType()):
        source = f"c{carry.index(text)}"
    else:
        source = TEXT
        inside.append(named(text).cast("binary").alias(TEXT))
    fields = [T.StructField(f"c{i}", k) for i, k in enumerate(kinds)]
    schema = T.StructType([*fields, *(T.StructField(f"m{i}", f.dataType) for i, f in enumerate(made))])
    arrow = to_arrow_schema(schema)
    out = df.select(*inside).mapInArrow(released(lambda batches: run(batches, source, arrow)), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), *(F.col(f"m{i}").alias(f.name) for i, f in enumerate(made)))


def map_texts(df: DataFrame, carry: list[str], text: str, function: Callable[[pa.Array], list], made: str) -> DataFrame:
    """``carry`` and the columns ``made`` (in DDL), which ``function`` gives for the texts of a stretch of rows."""
    kinds = T._parse_datatype_string(made)

    def run(batches: Iterator[pa.RecordBatch], source: str, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        n = len(carry)
        for piece in pieces(batches, source):
            values = function(piece.column(source))
            columns = [*(piece.column(f"c{i}") for i in range(n)), *(pa.array(v, k) for v, k in zip(values, arrow.types[n:], strict=True))]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, arrow.types, strict=True)], schema=arrow)

    return map_rows(df, carry, text, run, kinds)
