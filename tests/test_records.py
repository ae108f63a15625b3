"""The store, envelopes, job matching, reports, batches, epochs and datasets against brute force, and their edge cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from doclens.operators import pipeline, scoring, store
from doclens.operators.numbering import batches, numbered
from doclens.plans import rendered
from doclens.sources import writers


def files_of(path):
    return {f for f in os.listdir(path) if f.endswith(".parquet") and not f.startswith((".", "_"))}


def insert(spark, path, names, partitions=3):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").repartitionByRange(partitions, "i").sortWithinPartitions("i")
    return store.insert(rows, path, F.struct("n"), F.col("n"), F.lit("form"), F.lit(None).cast("string"), F.lit(None).cast("string"))


def test_insert_and_delete(spark, tmp_path):
    path = str(tmp_path / "a store")
    first = insert(spark, path, "abcdefgh")
    assert [(r.id, r.file_name, r.confidence, r.raw_text) for r in first.orderBy("id").collect()] == [(i + 1, n, 0.0, "") for i, n in enumerate("abcdefgh")]
    assert insert(spark, path, "").count() == 0
    second = insert(spark, path, "ijk", 2)
    assert [r.id for r in second.orderBy("id").collect()] == [9, 10, 11]
    before = files_of(path)
    holder = spark.read.parquet(path).where("id = 5").select("_metadata.file_path").first()[0]
    assert store.delete(spark, path, 5) and not store.delete(spark, path, 5) and not store.delete(spark, path, 99)
    after = files_of(path)
    assert len(before - after) == 1 and os.path.basename(holder.replace("%20", " ")) in before - after and len(after - before) == 1  # one file is written anew
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    for i in (6, 7, 4, 8):
        assert store.delete(spark, path, i)
    assert [r.id for r in insert(spark, path, "z").collect()] == [12]
    assert sorted(r.file_name for r in spark.read.parquet(path).collect()) == list("abcijkz")


def test_delete_cut_short_is_ended_by_another(spark, tmp_path):
    import shutil

    path = str(tmp_path / "store")
    insert(spark, path, "abcd", 1)
    (old,) = files_of(path)
    shutil.copy(f"{path}/{old}", tmp_path / "kept.parquet")
    assert store.delete(spark, path, 2)
    shutil.copy(tmp_path / "kept.parquet", f"{path}/{old}")  # as if it stopped before the old file went
    assert store.delete(spark, path, 2)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3, 4]


def test_numbers_and_batches_at_any_number_of_partitions(spark):
    rows = spark.range(100).selectExpr("id AS `a.b`", "id % 10 AS k", "'x' AS _number")
    told = [numbered(rows.repartitionByRange(n, "`a.b`").sortWithinPartitions("`a.b`"), "n", 5).collect() for n in (1, 7)]
    assert all(sorted((r["a.b"], r["n"]) for r in t) == [(i, i + 5) for i in range(100)] for t in told)
    seen = []
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(batches(rows.repartition(n).drop("_number"), F.col("k"), 32, 7).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2]
    assert sorted((r.batch, r.place) for r in seen[0]) == [(i // 32, i % 32) for i in range(100)]
    assert batches(rows.where("false"), F.col("k")).count() == 0
    assert [r["a.b"] for r in batches(rows, F.col("`a.b`"), 32, None).orderBy("batch", "place").collect()] == list(range(100))


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("parquet")


def test_dispatch_reads_once(spark, sf, tmp_path):
    rows = [(1, "bytes", "form", b"\x80\xff"), (2, "none", "form", None), (3, "kind", "memo", b"x"), (4, "no kind", None, b"x"), (5, "form", " FORM ", b"Email: a@b.example.com"), (6, "clash", "receipt", b"SHOP\nTEA 99999999999999999999.00\nTOTAL 2.00")]
    docs = spark.createDataFrame(rows, "doc_id long, `what.is` string, predicted_type string, text binary").withColumn("confidence", F.lit(1.0)).withColumn("payload", F.lit("own"))
    docs.write.parquet(str(tmp_path / "docs"))
    found = pipeline.dispatch(spark.read.parquet(str(tmp_path / "docs")))
    assert scans(found) == 1
    got = {r.doc_id: r for r in found.collect()}
    assert [got[i].error_message for i in range(1, 7)] == ["The text is not UTF-8.", "The document has no text.", "No extractor for document type: memo", "The document has no type.", None, None]
    assert got[5].form.email == "a@b.example.com" and got[5]["what.is"] == "form" and got[5].document_type == "form" and got[5].receipt is None and got[5].payload.startswith('{"')
    assert got[3].payload is None and got[3].needs_review and got[4].document_type == "unknown"
    assert got[6].receipt.total == 2
    writers.write_by_type(found.drop("what.is"), str(tmp_path / "out"))
    kinds = {r.doc_id: r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert kinds == {1: "quarantine", 2: "quarantine", 3: "quarantine", 4: "quarantine", 5: "form", 6: "receipt"}


def test_dispatch_with_other_extractors(spark):
    docs = spark.createDataFrame([(1, "memo", "to all"), (2, "form", "x")], "doc_id long, predicted_type string, text string")
    own = {"memo": lambda d, text: d.withColumn("length", F.length(text))}
    got = {r.doc_id: r for r in pipeline.dispatch(docs, extractors=own).collect()}
    assert got[1].memo.length == 6 and got[1].payload == '{"length":6}' and got[2].error_message == "No extractor for document type: form"


def brute_jobs(people, jobs, k):
    out = []
    for i, own in people:
        scored = [(-len(set(own) & set(w)) / len(set(w)), j, len(set(own) & set(w))) for j, w in jobs if set(own or []) & set(w or [])]
        out += [(i, n, j, hit, round(-s * 100, 2)) for n, (s, j, hit) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,k", [(1, 5), (2, 1), (3, 3)])
def test_best_jobs(spark, seed, k):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(14)]
    some = lambda most: sorted({"s0"} if rng.random() < 0.3 else set(), key=str) + rng.sample(names, rng.randint(0, most))
    people = [(i, some(6)) for i in range(60)] + [(100, []), (101, ["s1", "s1"]), (102, ["s1"])]
    jobs = [(i, some(5)) for i in range(150)] + [(200, []), (201, ["s1", "s1"])] + [(300 + i, ["s2", "s3"]) for i in range(20)]
    rows = spark.createDataFrame(people, "doc_id long, skills array<string>").union(spark.createDataFrame([(103, None)], "doc_id long, skills array<string>"))
    found = scoring.best_jobs(rows, spark.createDataFrame(jobs, "job_id long, job_skills array<string>"), k)
    assert sorted((r.doc_id, r["rank"], r.job_id, r.n_matched, r.match_score) for r in found.collect()) == brute_jobs(people, jobs, k)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_report_has_the_known_layout(spark):
    counts = {"form": 31, "invoice": 151, "receipt": 6, "resume": 374}
    pairs = spark.createDataFrame([(c, c) for c, n in counts.items() for _ in range(n)], "y_true string, y_pred string")
    lines = [r.value for r in writers.report_lines(store.full_report(pairs)).orderBy("place").collect()]
    assert lines == [
        "Accuracy : 1.0000", "Precision : 1.0000", "Recall : 1.0000", "F1 Score : 1.0000", "", "              precision    recall  f1-score   support", "",
        "        form       1.00      1.00      1.00        31", "     invoice       1.00      1.00      1.00       151", "     receipt       1.00      1.00      1.00         6",
        "      resume       1.00      1.00      1.00       374", "", "    accuracy                           1.00       562", "   macro avg       1.00      1.00      1.00       562", "weighted avg       1.00      1.00      1.00       562",
    ]
    assert store.full_report(pairs.where("false")).count() == 0 and writers.report_lines(store.full_report(pairs.where("false"))).count() == 0


def brute_epochs(rows, patience):
    out = []
    for run in {r[0] for r in rows}:
        best, since = None, 0
        for _, epoch, score in sorted(r for r in rows if r[0] == run):
            improved = score is not None and (best is None or score > best)
            best, since = (score, 0) if improved else (best, since + 1)
            out.append((run, epoch, score, best, improved, since, since == patience))
            if since == patience:
                break
    return sorted(out, key=str)


@pytest.mark.parametrize("stretch,patience", [(1024, 5), (3, 5), (4, 2), (1, 1)])
def test_best_epochs(spark, monkeypatch, stretch, patience):
    monkeypatch.setattr(store, "STRETCH", stretch)
    rng = random.Random(stretch)
    rows = [(run, e * (1 + run % 2), rng.choice([None, *range(e // 3 + 2)])) for run in range(12) for e in range(rng.randint(1, 30))] + [(99, 0, None), (99, 1, 1)]
    found = store.best_epochs(spark.createDataFrame(rows, "run int, epoch int, score int"), patience=patience)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_epochs(rows, patience)


def test_dataset_keeps_one_of_equal_content(spark):
    a = spark.createDataFrame([("x", 2), ("x", 1), (None, 3), ("", 4)], "text string, n int")
    b = spark.createDataFrame([("x", "p"), ("y", "q"), (None, "r")], "text string, path string")
    got = sorted((r.source, r.text, r.n, r.path) for r in store.dataset({"a": a, "b": b}, "text").collect() if r.text)
    assert len(got) == 2 and got[0][:2] == ("a", "x") and got[1] == ("b", "y", None, "q")
    assert store.dataset({"a": a, "b": b}, "text").where("text is null").count() == 2
    again = store.dataset({"a": a.repartition(3), "b": b}, "text")
    assert sorted(map(str, again.collect())) == sorted(map(str, store.dataset({"a": a, "b": b}, "text").collect()))


def test_envelopes_go_into_the_store(spark, sf, tmp_path):
    docs = rendered.forms(spark, sf).limit(5).withColumn("predicted_type", F.lit("form"))
    rows = pipeline.dispatch(docs).where("error_message is null")
    path = str(tmp_path / "store")
    kept = store.insert(rows, path, F.col("form"), F.lit("f"), F.col("document_type"), F.lit("90"), F.col("text"))
    assert kept.count() == 5 and store.records(spark.read.parquet(path)).where("type = 'Form' and confidence = 90").count() == 5
