"""The data source of labelled folders."""

import json
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from doclens.plans import queries as Q
from doclens.sources import files, folders


@pytest.fixture
def root(tmp_path):
    for name, data in {"test/memo/b.PNG": b"bb", "test/memo/deep/a.png": b"a", "test/form/c.jpg": b"", "test/form/_tmp/d.jpg": b"x", "train/memo/e.txt": b"eeee", "test/stray.png": b"x", "top.png": b"x", "train/label=a%2Fb/f.png": b"f", "train/label=__HIVE_DEFAULT_PARTITION__/g.png": b"g", "train/memo/.h.png": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


EVERY = {("test", "memo", 2, b"bb"), ("test", "memo", 1, b"a"), ("test", "form", 0, b""), ("train", "memo", 4, b"eeee"), ("train", "a/b", 1, b"f"), ("train", None, 1, b"g")}


def rows(df):
    got = [(r.split, r.label, r.length, None if r.content is None else bytes(r.content)) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_all_files(spark, root):
    found = folders.labelled_files(spark, root)
    assert rows(found) == EVERY
    assert rows(folders.labelled_files(spark, f"file:{root}")) == EVERY
    assert rows(folders.labelled_files(spark, f"file://{root}")) == EVERY
    assert rows(folders.labelled_files(spark, root, partitionBytes=1)) == EVERY
    assert folders.labelled_files(spark, root, partitionBytes=1).rdd.getNumPartitions() == 6


def test_options(spark, root):
    assert {(s, b) for s, _, _, b in rows(folders.labelled_files(spark, root, suffixes=".png, .JPG"))} == {(s, b) for s, _, _, b in EVERY if b != b"eeee"}
    assert rows(folders.labelled_files(spark, root, content="false")) == {(*r[:3], None) for r in EVERY}


@pytest.mark.parametrize(
    "where",
    ["label = 'memo'", "label IN ('form', 'a/b') AND split = 'test'", "label IS NULL", "label IS NOT NULL AND length > 0", "label <=> NULL", "label <> 'memo'", "NOT (label IN ('memo', 'x'))", "split LIKE 'tr%'", "path LIKE '%.png'", "NOT (path LIKE '%deep%')", "length >= 1 AND length < 4", "length <= 2 OR label = 'memo'", "label IN ('memo', NULL)", "NOT (label <=> 'memo')", "label > 'form'", "content = X'61'", "label = 'none'"],
)
def test_filters_as_spark_has_them(spark, root, where):
    plain = folders.labelled_files(spark, root)
    want = spark.createDataFrame(plain.collect(), plain.schema).where(where)
    assert rows(plain.where(where)) == rows(want)


def test_filters_reach_the_listing(root):
    def listed(*filters):
        reader = folders.FolderReader({"path": root})
        left = list(reader.pushFilters(list(filters)))
        return left, [(r[1], r[2]) for p in reader.partitions() for r in p.rows]

    left, found = listed(D.EqualTo(("label",), "form"), D.EqualTo(("split",), "test"))
    assert left == [] and found == [("test", "form")]
    odd = D.EqualTo(("content",), b"a")
    assert listed(odd)[0] == [odd]
    assert listed(D.Not(D.In(("label",), ("memo", "form"))))[1] == [("train", "a/b")]


def test_ruled_out_folders_are_not_listed(root, monkeypatch):
    seen = []

    class Recorded:
        def get_file_info(self, selector):
            seen.append(selector.base_dir.removeprefix(root))
            return folders.fs.LocalFileSystem().get_file_info(selector)

    reader = folders.FolderReader({"path": root})
    monkeypatch.setattr(reader, "open", lambda: (Recorded(), root))
    assert list(reader.pushFilters([D.EqualTo(("label",), "form"), D.In(("split",), ("test",))])) == []
    reader.partitions()
    assert seen == ["", "/test", "/test/form"]


def test_plan_has_no_filter_left(spark, root, capsys):
    folders.labelled_files(spark, root).where("label = 'memo'").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(label,memo)" in plan and not re.search(r"\bFilter\b", plan)


def test_empty_missing_and_large(spark, root, tmp_path, monkeypatch):
    (tmp_path / "none").mkdir()
    assert folders.labelled_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(PySparkException):
        folders.labelled_files(spark, str(tmp_path / "absent")).count()
    with pytest.raises(ValueError):
        folders.FolderReader({})
    monkeypatch.setattr(folders, "MAX_FILE_BYTES", 3)
    with pytest.raises(ValueError, match="e.txt has 4 bytes"):
        reader = folders.FolderReader({"path": root})
        [list(reader.read(p)) for p in reader.partitions()]


def test_batches_are_bounded(root, monkeypatch):
    monkeypatch.setattr(folders, "BATCH_BYTES", 4)
    reader = folders.FolderReader({"path": root})
    sizes = [b.column("length").to_pylist() for p in reader.partitions() for b in reader.read(p)]
    assert sum(map(len, sizes)) == 6 and all(sum(s) <= 4 for s in sizes)


def test_ocr_results_by_class(spark, tmp_path):
    for name, lines in {"test/memo/a.json": [{"text": "Hi", "confidence": 0.5}, {"text": "you", "confidence": 70}], "test/form/b.json": [{"text": "no", "confidence": 1}]}.items():
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text(json.dumps(lines))
    (tmp_path / "test/memo/broken.json").write_text("{")
    found = files.ocr_lines(folders.labelled_files(spark, str(tmp_path), suffixes=".json").where("label = 'memo'"))
    assert [tuple(r) for r in found.orderBy("line_no").select("label", "line_no", "text", "confidence").collect()] == [("memo", 0, "Hi", 50.0), ("memo", 1, "you", 70.0)]


def test_query_pushes_the_class(spark, sf):
    plan = Q.QUERIES["folders_read"](spark, sf)
    assert {r.label for r in plan.select("label").distinct().collect()} == {"de", "en"}
    assert plan.where(F.col("split") == "test").count() == 0
