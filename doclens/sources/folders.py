"""Labelled folders as a data source: ``root/<split>/<class>/.../<file>``, a row for each file.

``spark.read.format("labelled_folder").load(root)`` gives path, split, label, length and content. Filters on split, label, path and
length are worked out while the folders are listed: a split or class that they rule out is not looked into, and files that they rule out are
in no partition. The rest is dealt into partitions of about ``partitionBytes``, and read file by file in Arrow batches.

Options: ``suffixes`` (comma-joined, any case; all files without it), ``content`` (``false`` leaves the bytes unread and null),
``partitionBytes``. Stores are those that Arrow can open by the path (local, hdfs, s3, gs, abfs); for others there is
``files.labelled_images``, which goes through Spark's own reader. As with Spark's file sources, the paths are listed when the read is planned.

Cases: folders named ``key=value``, as Spark's writers make them, stand for the value, the default partition's name for null; files outside a class
folder, and files and folders whose name begins with ``_`` or ``.``, are left out; an empty folder gives no rows, one that is not there an error;
a file of more than ``MAX_FILE_BYTES`` is an error unless ``content`` is false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

SCHEMA = "path string, split string, label string, length long, content binary"
ARROW = pa.schema([("path", pa.string()), ("split", pa.string()), ("label", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
#: Name that Spark's writers give the folder of null.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
PARTITION_BYTES = 128 << 20
#: Opening a file counts as so many bytes, so that small files are not all in one partition.
OPEN_BYTES = 4 << 20
#: Bytes of an Arrow batch, but for a larger file, which is a batch of its own.
BATCH_BYTES = 8 << 20
MAX_FILE_BYTES = 1 << 30


@dataclass
class Files(D.InputPartition):
    """Files of one partition: path, split, label, length."""

    rows: list[tuple[str, str | None, str | None, int]]


def folder_value(name: str) -> str | None:
    """What a folder's name stands for."""
    _, equals, value = name.partition("=")
    return (None if value == NULL_FOLDER else unquote(value)) if equals else name


def test_of(f: D.Filter) -> tuple[str, Callable[[Any], bool]] | None:
    """Column and test of a filter; None if it is for Spark to work out."""
    if isinstance(f, D.Not):
        inner = test_of(f.child)
        if inner is None or isinstance(f.child, D.EqualNullSafe | D.IsNull | D.IsNotNull):
            return None
        return inner[0], lambda x: x is not None and not inner[1](x)
    column = ".".join(f.attribute) if hasattr(f, "attribute") else None
    if column not in ("path", "split", "label", "length"):
        return None
    value = getattr(f, "value", None)
    match f:
        case D.EqualTo():
            test = lambda x: x == value
        case D.In() if None not in value:
            test = lambda x: x in value
        case D.IsNull():
            return column, lambda x: x is None
        case D.IsNotNull():
            test = lambda x: True
        case D.StringStartsWith():
            test = lambda x: x.startswith(value)
        case D.StringEndsWith():
            test = lambda x: x.endswith(value)
        case D.StringContains():
            test = lambda x: value in x
        case D.GreaterThan() if column == "length":
            test = lambda x: x > value
        case D.GreaterThanOrEqual() if column == "length":
            test = lambda x: x >= value
        case D.LessThan() if column == "length":
            test = lambda x: x < value
        case D.LessThanOrEqual() if column == "length":
            test = lambda x: x <= value
        case _:
            return None
    return column, lambda x: x is not None and test(x)


class FolderReader(D.DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        if not options.get("path"):
            raise ValueError("labelled_folder needs a path")
        self.root = options["path"]
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.content = options.get("content", "true").lower() != "false"
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: dict[str, list[Callable[[Any], bool]]] = {}

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            found = test_of(f)
            if found is None:
                yield f
            else:
                self.tests.setdefault(found[0], []).append(found[1])

    def kept(self, column: str, value: Any) -> bool:
        return all(test(value) for test in self.tests.get(column, ()))

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if ":/" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[Files]:
        out, size = [], 0
        for row in self.listed():
            cost = (row[3] if self.content else 0) + OPEN_BYTES
            if not out or size + cost > self.most:
                out.append(Files([]))
                size = 0
            out[-1].rows.append(row)
            size += cost
        return out or [Files([])]

    def listed(self) -> Iterator[tuple[str, str | None, str | None, int]]:
        store, root = self.open()

        def below(path: str, recursive: bool = False) -> list[fs.FileInfo]:
            found = store.get_file_info(fs.FileSelector(path, recursive=recursive))
            hidden = lambda p: any(part[:1] in ("_", ".") for part in p[len(path) :].strip("/").split("/"))
            return sorted((f for f in found if not hidden(f.path)), key=lambda f: f.path)

        for split in below(root):
            if split.type != fs.FileType.Directory or not self.kept("split", folder_value(split.base_name)):
                continue
            for label in below(split.path):
                if label.type != fs.FileType.Directory or not self.kept("label", folder_value(label.base_name)):
                    continue
                for file in below(label.path, recursive=True):
                    fits = file.type == fs.FileType.File and (not self.suffixes or file.base_name.lower().endswith(self.suffixes))
                    if fits and self.kept("path", file.path) and self.kept("length", file.size):
                        yield file.path, folder_value(split.base_name), folder_value(label.base_name), file.size

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self.open()
        rows, size = [], 0
        for path, split, label, length in partition.rows:
            content = None
            if self.content:
                if length > MAX_FILE_BYTES:
                    raise ValueError(f"{path} has {length} bytes, more than a row can hold; read it with content=false")
                with store.open_input_file(path) as file:
                    content = file.read()
                if rows and size + length > BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            rows.append((path, split, label, length, content))
            size += length if self.content else len(path)
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class LabelledFolder(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "labelled_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark hand filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LabelledFolder)


def labelled_files(spark: SparkSession, root: str, **options: str | int) -> DataFrame:
    """Files below ``root`` by split and class."""
    register(spark)
    return spark.read.format("labelled_folder").options(**options).load(root)
