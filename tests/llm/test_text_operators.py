"""Operators on texts against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from doclens.llm import decontamination, licenses, mixing, ngram_join, quality, toxicity
from doclens.llm.wavelet import WaveletMatrix
from doclens.llm.words import ALNUM, NOT_SPACE, text_bytes, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, ids=None, source=None):
    rows = [(i if ids is None else ids[i], t, "en", source(i) if source else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower_words(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


@pytest.mark.parametrize("table,pattern", [(ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NOT_SPACE, r"[^\x20\x09-\x0D]+")])
def test_words(table, pattern):
    texts = ["", None, "A b", "éa É x\x0by-z", "  tail ", "one", " nb　sp"]
    column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    words = words_of(*text_bytes(column), table)
    data = b"".join((t or "").encode() for t in texts)
    got = [[data[s:e].decode().translate(LOWER) for s, e in zip(words.start[a:b], words.end[a:b])] for a, b in itertools.pairwise(words.first)]
    assert got == [lower_words(t, pattern) for t in texts]
    by_hash = {}
    for w, h in zip(itertools.chain(*got), words.hash.tolist()):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(itertools.chain(*got)))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_wavelet_matrix(n):
    symbols = np.random.default_rng(n).integers(0, 300, n).astype(np.uint16)
    tree = WaveletMatrix.from_bytes(WaveletMatrix.build(symbols, 9).to_bytes())
    assert (tree.decode() == symbols).all()
    if n:
        at = np.arange(n)
        assert (tree.access(at) == symbols).all()
        for s in {*symbols[:5].tolist(), 511}:
            assert tree.count(s) == (symbols == s).sum()
            assert (tree.occurrences(s) == np.flatnonzero(symbols == s)).all()
            assert (tree.rank(np.full(n, s), at) == np.cumsum(symbols == s) - (symbols == s)).all()


def test_fm_index_against_search():
    rng = np.random.default_rng(1)
    runs = [rng.integers(1, 4, k).tolist() + [0] for k in (1, 30, 30, 5, 80)]
    runs.append(runs[1])
    symbols = np.array(sum(runs, []))
    index = decontamination.FMIndex(symbols, 2, sample=7)
    for k in (1, 2, 4):
        phrases = np.array(list(itertools.product((1, 2, 3), repeat=k)))
        rows, of = decontamination.spread(*index.search(phrases))
        found = sorted(zip(of.tolist(), index.locate(rows).tolist()))
        assert found == sorted((i, p) for i, ph in enumerate(phrases.tolist()) for p in range(len(symbols)) if symbols[p : p + k].tolist() == ph)


def brute_contamination(texts, items, window=13):
    out = []
    for text in texts:
        w, hit, ids = lower_words(text), set(), set()
        for item, phrase in items:
            p = lower_words(phrase)
            n = min(window, len(p))
            windows = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if p else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= {str(item)} - {"None"}
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 60])
def test_decontamination(spark, block_bytes):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    vocabulary = ["a", "b", "É", "d9", "ee"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((3, 13, 14, 20, 20, 1, 0))] + [(3, "A b, A"), (None, "d9 d9 d9 d9"), (11, None)]
    items.append((12, items[3][1]))
    texts = [None, "", "zz", "a", " ".join(rng.choice(vocabulary) for _ in range(400)), items[3][1].upper() + " tail " + items[1][1], "x " * 300 + items[2][1], items[4][1], items[4][1]]
    docs = docs_of(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("spans", F.lit(1))
    found = decontamination.scan(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    rows = found.withColumn("sha", F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated) for r in rows] == brute_contamination(texts, items)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert sum(len(lower_words(raw[s.start_byte : s.end_byte].decode())) for s in r.spans) == r.n_hit
    cut = decontamination.without_spans(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [len(lower_words(r.text)) for r in cut] == [r.n_words - r.n_hit for r in rows]


def test_decontamination_of_nothing(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.scan(docs_of(spark, []), items).count() == 0
    row = decontamination.scan(docs_of(spark, ["a b"]), items).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = lower_words(t, r"[^\x20\x09-\x0D]+")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            group = [group[i] if g == group[j] else g for g in group]
    low = {g: min((ids[i] for i in range(len(ids)) if group[i] == g and ids[i] is not None), default=None) for g in group}
    return sorted([(ids[i], len(sets[i]), low[group[i]] if sets[i] else ids[i]) for i in range(len(texts))], key=str)


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(60):
        base = [word() for _ in range(rng.choice((6, 20, 80, 200)))]
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 3))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 2, 4, 8))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" \t".join(copy))
        if rng.random() < 0.5:
            texts.append(" ".join([word() for _ in range(40)] + passage + [word() for _ in range(30)]))
    chain = [word() for _ in range(120)]
    for i in range(30):  # each like the next, the ends unlike
        chain = chain[:]
        chain[4 * i] = word()
        texts.append(" ".join(chain))
    return texts


@pytest.mark.parametrize("short,frequent,salt", [(8, 16, 4096), (2, 2, 4)])
def test_ngram_join(spark, monkeypatch, short, frequent, salt):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", salt)
    texts = near_copies(frequent)
    ids = [None if i == 9 else 7 * i % 1009 for i in range(len(texts))]
    got = ngram_join.components(docs_of(spark, texts, ids).repartition(5)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute_components(texts, ids)


def test_ngram_join_keeps_one_of_each(spark):
    texts = ["a b c d e f g"] * 3 + [None, "", "other words stand here now and then", "other words stand here now and then"]
    docs = docs_of(spark, texts, [5, 5, 3, 8, 9, None, 1])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "8", "9", "None"]
    assert ngram_join.components(docs_of(spark, [])).count() == 0


def test_derived_answers_agree_with_counted_ones():
    rng = np.random.default_rng(2)
    portion = ngram_join.Portion()
    base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    for i in range(25):
        own = base.copy()
        own[rng.integers(0, 400, rng.integers(0, 60))] = rng.integers(0, 1 << 60)
        portion.sets[i] = np.unique(own)
    for a, b in itertools.combinations(range(25), 2):
        x, y = set(portion.sets[a].tolist()), set(portion.sets[b].tolist())
        assert portion.linked(a, b) == (100 * len(x & y) >= 75 * len(x | y))
    assert portion.counted < 25 * 24 // 2


def test_licenses(spark):
    from pyspark.sql import functions as F

    texts = [
        None, "", "mit license MIT  License", "Licensed under the Apache License, Version 2.0.\nmore words", "the license of mit", "x GNU General Public\nLicense y",
        "Licensed under CC BY-NC 4.0.", "MIT licenses", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation", "word " * 5000 + "mit license",
    ]
    rows = licenses.scan(docs_of(spark, texts).withColumn("labels", F.lit(0))).orderBy("doc_id").collect()
    for text, r in zip(texts, rows):
        w = lower_words(text)
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        held = set()
        for block in (text or "").split("\n"):
            b = set(lower_words(block))
            full = [(label, t) for label, t in licenses.TEMPLATES if len(b & (s := set(lower_words(t)))) >= licenses.THRESHOLD * len(s)]
            held |= {label for label, t in full if not any(set(lower_words(t)) < set(lower_words(o)) for _, o in full)}
        assert r.labels == ",".join(sorted(held | {label for _, label in places}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_wrapped_license_notices(spark):
    import textwrap

    full = [(label, t) for label, t in licenses.TEMPLATES if len(t.split()) > 4]
    texts = ["some code here\n" + "\n".join(" * " + line for line in textwrap.wrap(t, 20)) + "\nmore code" for _, t in full]
    texts.append("You should have received a copy of the GNU Lesser General Public License\nalong with this library.")
    texts.append("\n".join(w + " filler" * 30 for w in full[1][1].split()))
    rows = licenses.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    for (label, _), r in zip(full, rows):
        assert label in r.labels.split(",") and r.score >= 0.9 and r.blocks
    assert rows[-2].labels == "gpl,lgpl" and rows[-2].base_labels == "gpl"
    assert rows[-1].labels == ""


def test_mixing(spark):
    rng = random.Random(0)
    texts = ["w " * rng.choice((0, 1, 5, 50, 400)) for _ in range(300)] + [None, "", "w w w\x0bw"]
    source = lambda i: None if i % 7 == 0 else f"s{min(i % 5, 3)}"
    docs = docs_of(spark, texts, source=source)
    rows = mixing.mix(docs, bucket_rows=16).collect()
    again = mixing.mix(docs.repartition(7), bucket_rows=16).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    sizes, taken = {}, {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r["size"] == n and 0 <= r.taken <= 3 * n
        assert len(r.positions) == -(-r.taken // n) if n else r.positions == []
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        sizes[r.source] = sizes.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + r.taken
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([sizes[s] for s in names])
    assert sum(goal) == pytest.approx(sum(sizes.values()))
    for s, g in zip(names, goal):
        assert taken[s] == round(g) and g <= 3 * sizes[s]
        assert all(r.target == g and r.source_size == sizes[s] for r in rows if r.source == s)
    whole = mixing.training_sequence(docs, bucket_rows=16)
    assert whole.columns == docs.columns and whole.count() > 0
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_targets_stop_and_reshare():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 1000, 1000]) == pytest.approx([30, 1980 * 2 / 3, 1980 / 3])
    assert mixing.targets([0, 0]) == [0, 0]


def test_positions_invert_the_schedule(spark):
    from pyspark.sql import functions as F

    levels = spark.range(11).select((F.col("id") / 10).alias("u"))
    for a in (0.5, 1.0, 1.5, 2.0):
        for r in levels.select("u", mixing.position(F.col("u"), F.lit(a)).alias("t")).collect():
            assert a * r.t + (1 - a) * r.t**2 == pytest.approx(r.u, abs=1e-9)


TOXIC = ["grumblefex", "snarkzot"]


def labelled(spark, n=600):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "ne", "to", "li", "mu", "re"]) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.choice((8, 30, 120)))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(1 + len(w) // 30):
                w[rng.randrange(len(w))] = rng.choice(TOXIC)
        texts.append(" ".join(x + "###" for x in w) if bad else " ".join(w))
        labels.append((i, int(not bad), int(toxic)))
    return docs_of(spark, texts), spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int"), labels


def test_toxicity_held_out_and_misspelled(spark):
    from pyspark.sql import functions as F

    docs, labels, truth = labelled(spark)
    held = F.col("doc_id") % 4 == 2
    model = toxicity.train(docs, labels, "toxic", ~held)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    wrong = sum((scores[i] >= 0.3) != bool(t) for i, _, t in truth)
    assert wrong <= 0.05 * len(truth)
    odd = docs_of(spark, ["ba ne grumblefexx to", "ba ne to li", None, "", "... !!"]).withColumn("score", F.lit("x"))
    got = [r.score for r in toxicity.score(odd, model).orderBy("doc_id").collect()]
    assert got[0] > 0.5 > 0.3 > got[1] and got[2] == got[3] == got[4]
    empty = toxicity.train(docs, labels.where("false"), "toxic", F.lit(True))
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, empty).collect())
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_quality_from_positives_and_unlabelled(spark):
    from pyspark.sql import functions as F

    docs, labels, truth = labelled(spark)
    held = F.col("doc_id") % 5 == 0
    model = quality.train(docs, labels, "quality", ~held)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert sum((scores[i] >= 0.3) != bool(q) for i, q, _ in truth) <= 0.05 * len(truth)
    assert 0.6 < model.prior < 0.98
    odd = docs_of(spark, [None, "", "a", "b " * 30000])
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    none = quality.train(docs_of(spark, []), labels, "quality", F.lit(True))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def test_quality_with_few_or_all_labels(spark):
    from pyspark.sql import functions as F

    docs, _, truth = labelled(spark)
    every = spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    for labels, learn, sample in ((every, F.col("doc_id") % 5 != 0, quality.SAMPLE), (every.where("doc_id < 60"), F.lit(True), 200)):
        model = quality.train(docs, labels, "quality", learn, sample)
        scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
        assert sum((scores[i] >= 0.3) != bool(q) for i, q, _ in truth) <= 0.05 * len(truth)
    one = quality.train(docs, every.where("doc_id = 1"), "quality", F.lit(True))
    assert all(0 <= r.score <= 1 for r in quality.score(docs, one).collect())


def test_quality_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    rows = [(7, f"text number {i} of one id", "s") for i in range(400)] + [(i + 1000, f"other text {i}", "s") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(7, 1), (1001, 1), (1002, 0)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u, *rest: seen.append((len(p), len(u))) or fit(p, u, *rest))
    from pyspark.sql import functions as F

    quality.train(docs, labels, "quality", F.lit(True), sample=40)
    assert sum(seen[0]) <= 2 * 2 * 40


def test_fold_rule(spark):
    from doclens.llm.queries import remainder

    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", remainder(4).alias("m")).collect()
    assert all(r.m == (-1 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4) for r in rows)


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_hashes_of_structured_words():
    a, b = thue_morse(4096), thue_morse(4096, "ba")
    words = words_of(*text_bytes(pa.array([f"{a} {b} {a}{b} {b}{a}".encode()], pa.binary())), ALNUM)
    assert len(set(words.hash.tolist())) == 4


def test_structured_words_are_told_apart(spark):
    from pyspark.sql import functions as F

    a, b = (thue_morse(2048, x) for x in ("ab", "ba"))
    texts = [f"{a} {b} " * 4, f"{b} {a} " * 4, f"{a} " * 20, f"{b} " * 20]
    got = ngram_join.components(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == sorted(brute_components(texts, range(4)))
    items = spark.createDataFrame([(1, f"{b} " * 13)], "item_id long, text string")
    assert [r.contaminated for r in decontamination.scan(docs_of(spark, texts), items).orderBy("doc_id").collect()] == [False, False, False, True]
    odd = docs_of(spark, texts).withColumn("_bytes", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("c0", F.lit(3)).withColumn("m0", F.lit(4))
    assert decontamination.clean_documents(odd, items).columns == odd.columns
    model = quality.Model(np.zeros(len(quality.FEATURES)), np.ones(len(quality.FEATURES)), [], 0.5)
    for found in (licenses.scan(odd), quality.score(odd, model), ngram_join.one_of_each(odd)):
        row = found.orderBy("doc_id").collect()[0].asDict()
        assert [row[c] for c in ("text", "_bytes", "a.b", "c0", "m0")] == [texts[0], 1, 2, 3, 4]


def test_one_of_each_with_equal_ids(spark):
    x, y = "one two three four five six seven", "all other words stand in this one here"
    docs = docs_of(spark, [x, x, y], [3, 5, 5])
    assert sorted((r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect()) == [(3, x), (5, y)]
    docs = docs_of(spark, [x, y, x, y.upper(), "", ""], [5, 5, 5, 5, 5, 5])
    kept = sorted((r.doc_id, r.text.lower()) for r in ngram_join.one_of_each(docs).collect())
    assert kept == [(5, ""), (5, ""), (5, y), (5, x)]


def test_blocks_of_a_list_leave_out_nothing():
    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(5, 40, 300))
    position = rng.integers(0, size - (3 * size + 3) // 4 + 1)
    order = np.lexsort((position, size))
    size, position = size[order], position[order]
    blocks = ngram_join.Blocks(size, position)
    for i in range(300):
        some = [j for j in range(300) if min(size[i] - position[i], size[j] - position[j]) >= -(-3 * (size[i] + size[j]) // 7) and 4 * min(size[i], size[j]) >= 3 * max(size[i], size[j])]
        assert blocks.candidates(i).tolist() == some


@pytest.mark.parametrize("slice_,portion", [(4, 3), (1 << 15, 1024)])
def test_ngram_join_in_slices(spark, monkeypatch, slice_, portion):
    for name, value in (("SLICE", slice_), ("PORTION", portion), ("SHORT_LIST", 2), ("FREQUENT", 2), ("SALT_ROWS", 4), ("FOUND", 5)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(1)
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join(common + [f"w{rng.randrange(8)}" for _ in range(rng.randint(0, 6))]) for _ in range(150)]
    got = ngram_join.components(docs_of(spark, texts).repartition(5)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute_components(texts, range(len(texts)))


def test_licenses_in_long_lines(spark):
    """Words scattered over a long line are no notice; a notice inside one is, wherever it stands."""
    rng = np.random.default_rng(8)
    prose = [f"w{x}" for x in rng.integers(0, 3000, 6000)]
    scattered = list(prose)
    for i, w in enumerate("unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or implied".split()):
        scattered[i * 150] = w
    notice = "this Font Software is licensed under the SIL Open Font License version 1.1".split()
    texts = ["by the way, he was licensed to work under 4 and 0 rules, cc them", " ".join(scattered), " ".join(prose[:3000] + notice + prose[3000:]), " ".join(notice + prose), " ".join(prose + notice), "x\n" + " ".join(prose[:40] + notice + prose[:40])]
    rows = licenses.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["", "", "ofl", "ofl", "ofl", "ofl"]
    full = [(label, t) for label, t in licenses.TEMPLATES]

    def brute(text):
        """Labels of templates of whose distinct words a window of twice their words holds enough."""
        words, out = [w.encode() for w in lower_words(text)], set()
        for label, t in full:
            own, size = set(licenses.tokens(t)), licenses.WINDOW * len(licenses.tokens(t))
            need = math.ceil(licenses.THRESHOLD * len(own) - 1e-9)
            if any(len(own & set(words[i : i + size])) >= need for i in range(max(1, len(words) - size + 1))):
                out.add(label)
        return out

    pieces_ = [w for _, t in full for w in t.split()]
    mixed_ = [" ".join(pieces_[i] if rng.random() < 0.9 else "filler" for i in range(a, a + 150)) for a in rng.integers(0, len(pieces_) - 150, 12).tolist()]
    for text, r in zip(mixed_, licenses.scan(docs_of(spark, mixed_)).orderBy("doc_id").collect(), strict=True):
        assert set(r.labels.split(",")) - {""} <= brute(text) | set(r.base_labels.split(","))
        lost = brute(text) - set(r.labels.split(","))
        assert all(label in {"cc-by", "mit", "gpl", "apache", "bsd", "unlicense", "lgpl", "agpl", "cc-by-nc", "cc-by-sa"} for label in lost)  # those that a larger found one has all words of
