"""Pages, vectors, token shards and the pipeline against brute force, and their edge cases."""

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from doclens.llm import html_text, neighbours, token_store, url_filter
from tests.llm.test_text_operators import docs_of, lower_words

ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b>part,\n two&nbsp;lines.<br>Next<p>Ti.</p></article>"
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- note --><div class="ad">Buy this long advert text now, it is far longer than the article.</div>
{ARTICLE}<aside>side</aside><div id="comments"><p>A reader wrote quite a long comment about all of this here.</p></div><form>Mail <input></form><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more First boldpart, two lines. Next Ti."


@pytest.mark.parametrize(
    "html,text",
    [
        (PAGE, TEXT), (None, ""), ("", ""), ("plain words", "plain words"), ("<nav>menu</nav>", ""), (ARTICLE[:-17], TEXT[:-4]),
        ("<nav><ul><li>left open" + ARTICLE, TEXT), ("</div></p>" + ARTICLE + "</b>", TEXT), ("<article><p>a</p><div class='share-box'>s</div><footer>f</footer><p>b</p></article>", "a b"),
        ("<body><div><p>" + "long content words " * 20 + "</p></div><div><a>x</a><a>y</a></div></body>", ("long content words " * 20).strip()),
        ("<article>&lt;p&gt; &#233; &unknown; <script>x</script></article>", "<p> é &unknown;"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("start,end", [('<html class="no-sidebar"><body class="single comments-open widget">', ""), ('<div class="content has-sidebar">', "</div>"), ('<div id="sidebar-layout"><div class="share">', "</div></div>"), ('<main><div class="widget">', "</div><p>b</p></main>")])
def test_names_on_wrappers(start, end):
    related = '<div class="related"><article>Other</article></div>'
    assert html_text.main_text(start + ARTICLE + end).removesuffix(" b") == TEXT
    assert html_text.main_text(start + "<p>" + "plain words " * 20 + "</p>" + end) == ("plain words " * 20).strip() or "has-" not in start and "body" not in start
    assert html_text.main_text(ARTICLE + related) == TEXT


@pytest.mark.parametrize(
    "html,text",
    [
        ("<head><title>x</title><body><p>Hello body</p>", "Hello body"), ("<head><meta charset=u>Bare words", "Bare words"), ("<p>a</p><select><option>x<p>After</p>", "a After"),
        ('<div class="comments"><article>A comment of some length by a reader</article></div><div class="post"><p>Real text</p></div>', "Real text"),
        ("<ul><li>Home</li><li>About us</li></ul><div class='post-share-wrapper'><p>" + "The whole text. " * 9 + "</p></div>", ("The whole text. " * 9).strip()),
        ("a <!-- open comment <p>b", "a"), ("<p>a</p><script>if (x <!-- y) {}</script><p>b</p>", "a b"), ("<div><p>" + "first part " * 9 + "</p></div><div><p>" + "next part " * 9 + "</p></div>", ("first part " * 9 + "next part " * 9).strip()),
        ("<article><p>" + "long text " * 200_000 + "</p></article>", ("long text " * 200_000).strip()),
    ],
)
def test_open_elements_and_names(html, text):
    assert html_text.main_text(html) == text


def test_ratios_decide(sf):
    """Without any markup the ratios alone give the article on nine pages of ten, and no other choice of regions does."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    full = [html_text.main_text(p) for p in pages]
    bare, flat = ([html_text.main_text(p, markup=False, ratios=r) for p in pages] for r in (True, False))
    right = lambda other: sum(a == b for a, b in zip(full, other, strict=True)) / len(pages)
    assert right(bare) > 0.9 and right(flat) < 0.2


def test_html_query_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], "page_id long, url string, html string").selectExpr("*", "'clash' AS text")
    rows = html_text.extract(pages, carry=["page_id", "url", "text"]).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in rows] == [(1, TEXT, len(TEXT)), (2, "", 0), (2, "", 0)]
    assert html_text.extract(pages.where("false")).count() == 0
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def brute_above(rows):
    """Estimate above each (host, template), from the pages' templates alone."""

    def share(pages, above):
        own = [url_filter.RULES[r.rule] == "block" for r in pages if r.rule]
        unknown = max(len(pages) - len(own), url_filter.SMOOTHING)
        return (sum(own) + unknown * above) / (len(own) + unknown)

    known = [url_filter.RULES[r.rule] == "block" for r in rows if r.rule]
    out = {}
    for host, template in {(r.host, r.template) for r in rows}:
        names, pages = template.split("/")[1:], [r for r in rows if r.host == host]
        above = share(pages, min(0.5, sum(known) / max(1, len(known))))
        for depth in range(1, len(names) + 1):
            pages = [r for r in pages if r.template.split("/")[1 : depth + 1] == names[:depth]]
            sparse = len(pages) < url_filter.LEAST_PAGES and sum(r.rule is not None for r in pages) < url_filter.LEAST_LABELLED
            if sparse or len({re.sub("[0-9]+", "#", r.path) for r in pages}) == 1:
                break
            above = share(pages, above)
        out[host, template] = above
    return out


def test_url_rules_and_templates(spark):
    urls = [None, "", "no scheme", "://", "http://A.NET", "http://A.NET/x", "http://net/", "https://example.net/en/1?q#h", "http://x.example.net/en", "http://example.com/de/", "http://notnet/", "http://a://b/c", "http://É.org/fr/x", "http://b.org?x/fr/", "HTTP://B.org/fr/#/net/"]
    urls += [f"http://h.example.com/{b}/{i}.html" for b in ("de", "en") for i in range(20)] + [f"http://w.example.com/p{chr(97 + i)}/de/" for i in range(12)] * 2
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 AS verdict")
    rows = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        r = rows[i]
        assert (r.host, r.path, r.rule) == brute_rule(u), u
        assert r.verdict == (url_filter.RULES[r.rule] if r.rule else "block" if r.purity >= url_filter.REJECT else "allow")
    groups = {}
    for r in rows.values():
        groups.setdefault((r.host, r.template), []).append(r)
    above = brute_above(list(rows.values()))
    for key, group in groups.items():
        own = [url_filter.RULES[r.rule] for r in group if r.rule]
        assert group[0].purity == pytest.approx((own.count("block") + url_filter.SMOOTHING * above[key]) / (len(own) + url_filter.SMOOTHING))
    assert {r.template for r in rows.values() if r.host == "h.example.com"} == {"/de/#.html", "/en/#.html"}
    assert {r.template for r in rows.values() if r.host == "w.example.com"} == {"/*/de"}
    assert url_filter.judge(pages.where("false")).count() == 0


def test_url_filter_passes_columns_of_any_name(spark, monkeypatch):
    rows = [(i, f"http://h.example.net/x/{i % 3}", "own", "shape", i, "v") for i in range(40)] + [(99, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, `a.b` string, _shape string, `n` int, Verdict string")
    for most in (url_filter.BROADCAST_ROWS, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
        got = url_filter.judge(pages)
        assert got.columns == ["page_id", "url", "a.b", "_shape", "n", "host", "path", "rule", "template", "purity", "verdict"]
        told = got.collect()
        assert len(told) == 41 and all(r["a.b"] == "own" and r["_shape"] == "shape" and r.verdict == "block" for r in told if r.page_id < 99)
        assert [(r.host, r.path, r.n) for r in told if r.page_id == 99] == [("", "", None)]


def test_similar_branches_merge(spark):
    paths = [("h", f"/{b}/#", 20, 20, n) for b, n in (("a", 19), ("b", 18), ("c", 2), ("d", 0))] + [("h", "/e", 9, 0, 0)]
    rows = url_filter.templates(spark.createDataFrame(paths, "host string, shape string, n long, n_labelled long, n_blocked long")).collect()
    assert {r["shape"]: r.template for r in rows} == {"/a/#": "/a|b/#", "/b/#": "/a|b/#", "/c/#": "/c|d/#", "/d/#": "/c|d/#", "/e": "/e"}


def test_the_rest_of_a_bad_host_is_blocked(spark):
    urls = [f"http://bad.example.com/de/{i}" for i in range(60)] + [f"http://bad.example.com/{s}/{i}" for s in ("en", "x") for i in range(6)]
    urls += [f"http://good.org/fr/{i}" for i in range(40)] + [f"http://good.org/en/{i}" for i in range(6)] + ["http://new.example.com/en/1"]
    rows = url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).collect()
    assert {(r.host, r.verdict) for r in rows if r.rule is None} == {("bad.example.com", "block"), ("good.org", "allow"), ("new.example.com", "allow")}
    above = brute_above(rows)
    for r in rows:
        own = [url_filter.RULES[o.rule] for o in rows if o.rule and (o.host, o.template) == (r.host, r.template)]
        assert r.purity == pytest.approx((own.count("block") + url_filter.SMOOTHING * above[r.host, r.template]) / (len(own) + url_filter.SMOOTHING))


def test_clean_sections_of_a_wide_host_stay_allowed(spark):
    clean = [f"s{chr(97 + i)}" for i in range(20)]
    urls = [f"http://a.example.com/de/{i}" for i in range(24)] + [f"http://a.example.com/{s}/{i}" for s in clean for i in range(3 if s < "sf" else 6)]
    deep = [("h", f"/a/b/c/d/{s}/#", 10, 10, 10 * (s == "bad")) for s in ("bad", "good")] + [("h", f"/a/b/c/d/x{i}/y/{i}", 1, 0, 0) for i in range(3)]
    deep += [("m", f"/p{i:02}/{k}", 5, 5, 5) for i in range(20) for k in "ab"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = url_filter.judge(pages).collect()
    assert {r.verdict for r in rows if r.path.startswith("/de/")} == {"block"}
    assert {r.verdict for r in rows if not r.path.startswith("/de/")} == {"allow"}
    assert {r.template for r in rows if r.path.startswith("/sk/")} == {"/sk/#"}
    rows = url_filter.templates(spark.createDataFrame(deep, "host string, shape string, n long, n_labelled long, n_blocked long")).collect()
    got = {r["shape"]: r.template for r in rows}
    assert len(rows) == len(deep) and got["/a/b/c/d/bad/#"] == "/a/b/c/d/bad/#" and got["/a/b/c/d/good/#"] == "/a/b/c/d/good/#"
    assert {got[f"/a/b/c/d/x{i}/y/{i}"] for i in range(3)} == {"/a/b/c/d/*/*/*"}
    assert {t for s, t in got.items() if s.startswith("/p")} == {"/" + "|".join(f"p{i:02}" for i in range(8)) + "|+12/a|b"}


def brute_neighbours(rows, k=5):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(np.asarray(v, float)).all() and any(v)]
    out = {}
    for i, q in good:
        if i % 50 == 0:
            near = sorted((-float(q @ v / np.sqrt((q @ q) * (v @ v))), j) for j, v in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_neighbours_small_and_odd(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows[7] = (7, rows[50][1])
    rows[8] = (8, [2 * x for x in rows[50][1]])
    rows += [(200, None), (250, [0.0] * 8), (300, [float("nan")] * 8), (350, [None] + [1.0] * 7), (400, [1.0] * 3), (None, [1.0] * 8), (450, [float("inf")] * 8)]
    from pyspark.sql import functions as F

    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {}
    for r in neighbours.search(base, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_neighbours(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    assert neighbours.search(base.where("vec_id < 3"), F.col("vec_id") % 50 == 0).count() == 2
    assert neighbours.search(base.where("false"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_neighbours_recall(spark, monkeypatch, clustered):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neighbours, "SLICE_ROWS", 100)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8)) + (5 * rng.normal(size=(20, 8))[rng.integers(0, 20, 3000)] if clustered else 0)
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    router = neighbours.train(base)
    assert router.parts == 16 and router.probes < (8 if clustered else 16)
    want = brute_neighbours(rows)
    found = [(r.query_id, r.vec_id) for r in neighbours.search(base, F.col("vec_id") % 50 == 0, router=router).collect()]
    assert len(found) == 5 * len(want)
    assert sum(v in [j for j, _ in want[q]] for q, v in found) >= 0.9 * len(found)


def test_balanced_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = neighbours.unit(rng.normal(size=(500, 4)))
    part = neighbours.balanced_parts(neighbours.graph(x, 5), x, 7, rng)
    assert np.bincount(part).max() <= -(-500 // 7)


@pytest.fixture(scope="module")
def tokenizer_file(tmp_path_factory):
    """A byte-level BPE file of the public vocabulary."""
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


ODD_TEXTS = [None, "", " ", "  two  spaces ", "tail \n\n x", "a\u00a0 b \u3000 c\u2003 d", "é ô ñ « x » ¿que ?", "it's we'll  don't", "<|endoftext|> x <|endoftext|>", "x" * 3000, "word " * 9000, "tab\t a\r\n b", "\x00 \x7f a", "日本 語 です", "1 23  456", "\u0085 x\u0085 y", "a\u200a b\u2028 c\u205f d\u1680 e"]


@pytest.mark.parametrize("shard_tokens", [1 << 22, 50])
def test_token_store_round_trip(spark, tokenizer_file, tmp_path, shard_tokens):
    from tokenizers import Tokenizer

    ids = [None if i == 3 else i // 2 for i in range(len(ODD_TEXTS))]
    docs = docs_of(spark, ODD_TEXTS, ids).repartition(3)
    path = str(tmp_path / "store")
    token_store.write(docs, path, tokenizer_file, shard_tokens)
    got = sorted(token_store.read(spark, path).collect(), key=lambda r: r.start)
    order = sorted(zip(ids, ODD_TEXTS), key=lambda x: (x[0] is not None, x[0], x[1] is not None, (x[1] or "").encode()))
    plain, start, every = Tokenizer.from_file(tokenizer_file), 0, []
    for r, (i, text) in zip(got, order, strict=True):
        own = [*plain.encode(text or "", add_special_tokens=False).ids, token_store.END]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(own)), text
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        start += len(own)
        every += own
    counts = {r.token: r.n for r in token_store.count_tokens(spark, path, [2, 220, 40000]).collect()}
    assert counts == {t: every.count(t) for t in (2, 220, 40000)}
    shards = [token_store.TokenShard(bytes(r.data)) for r in spark.read.parquet(path).orderBy("part", "seq").collect()]
    assert sum(len(s.lengths) for s in shards) == len(ODD_TEXTS)
    first = shards[0]
    whole = np.concatenate([first.tokens(d) for d in range(len(first.lengths))])
    assert (whole == np.array(every[: len(whole)])).all()
    assert len(first.occurrences(2)) == (whole == 2).sum()


def test_token_store_of_nothing(spark, tokenizer_file, tmp_path):
    token_store.write(docs_of(spark, []), str(tmp_path / "none"), tokenizer_file)
    assert token_store.read(spark, str(tmp_path / "none")).count() == 0


def test_encoder_of_white_space_runs(tokenizer_file):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = ["a\n\nb", "a\n\n\n\nb", " \n\nb", "abc\n\nabc", "a.\n\nb", "a\r\nb", "a \n", "b", "\n", "\nb", "", "a \n\n", "x"]
    texts += ["".join(rng.choice(["\n", "\n", "\n\n", " ", "\t", "\r", "\x0b", "\u00a0", "\u2003", "a", "Bc", "7", ".", "'s", "é", "×", "日"]) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    plain = Tokenizer.from_file(tokenizer_file)
    ids, counts = token_store.Encoder(tokenizer_file).encode(pa.array([t.encode() for t in texts], pa.binary()))
    for text, end, n in zip(texts, np.cumsum(counts), counts, strict=True):
        assert ids[end - n : end].tolist() == [*plain.encode(text, add_special_tokens=False).ids, token_store.END], text


def test_encoder_cache_starts_anew(tokenizer_file, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_store, "CACHE_PIECES", 5)
    encoder = token_store.Encoder(tokenizer_file)
    column = pa.array([b"a b c d", b"e f g h", b"a b"], pa.binary())
    whole, counts = encoder.encode(column)
    again = [encoder.encode(column.slice(i, 1))[0] for i in range(3)]
    assert (whole == np.concatenate(again)).all() and counts.tolist() == [5, 5, 3]


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    import corpus_pipeline
    from doclens.llm import mixing
    from tests.llm.test_text_operators import brute_components, brute_contamination

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = corpus_pipeline.quality_filter(spark, docs, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    rows = good.collect()
    unique = corpus_pipeline.near_duplicates(spark, good, sf)
    want = {c for _, _, c in brute_components([r.text for r in rows], [r.doc_id for r in rows])}
    assert sorted(r.doc_id for r in unique.collect()) == sorted(want)
    clean = corpus_pipeline.decontaminated(spark, unique, sf)
    rows = unique.collect()
    dirty = {r.doc_id for r, x in zip(rows, brute_contamination([r.text for r in rows], items)) if x[4]}
    assert {r.doc_id for r in clean.collect()} == want - dirty
    sequence = corpus_pipeline.mixed_sources(spark, clean, sf)
    times = {r.doc_id: round(r.taken / r["size"]) if r["size"] else 0 for r in mixing.mix(clean).collect()}
    got = [r.doc_id for r in sequence.collect()]
    assert {i: got.count(i) for i in times} == times
    assert {sequence.columns == docs.columns, clean.columns == docs.columns, good.columns == docs.columns, unique.columns == docs.columns} == {True}
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(got)
    assert max(r.start + r.n_tokens for r in out) == sum(r.n_tokens for r in out)


def test_lower_words_is_the_rule():
    assert lower_words("A-b É_9") == ["a", "b", "É", "9"]
    assert json.loads('"x"') == "x"


PARTS = ["a", "b", "Z", "9", ".", ",", "!", "'", " ", "  ", "\n", "\n\n", "\r", "\t", "\x0b", "\x0c", "é", "中", " ", " ", "　", "́", "😀", "<|endoftext|>", "'s", "'ll", "<", "×", "ß", " ", "\x85", "\x1c", "\x00", "٣", "²", "‍"]


def test_cached_pieces_encode_like_whole_texts(monkeypatch):
    import random

    from doclens.llm import token_store
    from doclens.llm.queries import tokenizer_path
    from doclens.llm.words import text_bytes

    encoder, rng = token_store.Encoder(tokenizer_path()), random.Random(1)
    texts = ["a\n\nb", "a\n\n\n\nb", " \n\nb", "word.\n\nNext line", "é\n\nb", "中\n\nb", "\n\n", "a \n b"]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(12000)]
    for low in range(0, len(texts), 100):
        column = pa.array([t.encode() for t in texts[low : low + 100]], pa.binary())
        data, offsets = text_bytes(column)
        (ids, counts), (whole, each) = encoder.encode(column), encoder.encode_whole(data.tobytes(), offsets)
        assert ids.tolist() == whole.tolist() and counts.tolist() == each.tolist()
    # pieces that share a hash are told apart by their bytes
    monkeypatch.setattr(token_store, "hashes_of", lambda data, start, end, kind: (end - start).astype("uint64") % 3)
    encoder.forget()
    column = pa.array([t.encode() for t in texts[:50]], pa.binary())
    data, offsets = text_bytes(column)
    for _ in range(2):
        assert encoder.encode(column)[0].tolist() == encoder.encode_whole(data.tobytes(), offsets)[0].tolist()


def test_neighbours_of_repeated_ids_and_odd_scales(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(100)]
    rows += [(50, rng.normal(size=6).tolist()), (50, rows[50][1]), (3, rows[4][1])]
    rows += [(120, [1e200 * x for x in rows[9][1]]), (121, [1e-200 * x for x in rows[8][1]]), (150, [5e-324] + [0.0] * 5), (130, [1e308] * 6)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    got = sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())
    whole = [np.array([float(x) for x in v]) for _, v in rows]
    one = [v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for v in whole]
    want = []
    for q, (i, _) in enumerate(rows):
        if i % 50 == 0:
            near = sorted((-round(float(one[q] @ one[c]), 12), j) for c, (j, _) in enumerate(rows) if c != q)[:5]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[3] for x in sorted(got, key=lambda x: (x[0], x[1], -x[3]))] == pytest.approx([x[3] for x in sorted(want, key=lambda x: (x[0], x[1], -x[3]))], abs=1e-9)
    assert sorted(x[2] for x in got) == sorted(x[2] for x in want)


def test_neighbours_with_too_few_in_their_parts(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    centres = 9 * rng.normal(size=(8, 6))
    rows = [(i, (centres[i % 8] + rng.normal(size=6)).tolist()) for i in range(600)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    router = neighbours.train(base)
    assert router.parts > 1 and router.probes < router.parts
    few = base.where("vec_id < 60 AND (vec_id % 8 <> 2 OR vec_id = 50)")
    found = neighbours.search(few, F.col("vec_id") % 50 == 0, router=router).groupBy("query_id").count().collect()
    assert sorted((r.query_id, r["count"]) for r in found) == [(0, 5), (50, 5)]


def test_new_pieces_go_to_the_library_together(tokenizer_file):
    """Pieces that are cut from each other wherever they stand are one text of a call; others stay texts of their own."""
    encoder, handed = token_store.Encoder(tokenizer_file), []
    library = encoder.tokenizer

    class Counted:
        def encode(self, text, **options):
            handed.append(1)
            return library.encode(text, **options)

        def encode_batch(self, texts, **options):
            handed.extend(texts)
            return library.encode_batch(texts, **options)

        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    texts = [" ".join(f"word{i}é" for i in range(n, n + 50)) + f"\n\xa0{n}" for n in range(0, 2000, 50)]
    ids, counts = encoder.encode(pa.array([t.encode() for t in texts], pa.binary()))
    assert len(handed) < 100 < len(encoder.keys)
    for text, end, n in zip(texts, np.cumsum(counts), counts, strict=True):
        assert ids[end - n : end].tolist() == [*library.encode(text, add_special_tokens=False).ids, token_store.END]
