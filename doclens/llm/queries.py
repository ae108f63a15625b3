"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import decontamination

    found = decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    digest = F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import token_store

    path = scratch_path(spark, "tokens")
    token_store.write(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_store.read(spark, path)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("blocks")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import url_filter

    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def remainder(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def _judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, "toxic", remainder(4) != 2)
    return _judged(toxicity.score(docs, model, ["doc_id"]), remainder(4) == 2)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import ngram_join

    return ngram_join.components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import html_text

    return html_text.extract(_table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def quality_model(docs: DataFrame, labels: DataFrame, learn):
    from doclens.llm import quality

    return quality.train(docs, labels, "quality", learn)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import quality

    docs = _table(spark, sf_dir, "documents")
    model = quality_model(docs, _table(spark, sf_dir, "labels"), remainder(5) != 0)
    return _judged(quality.score(docs, model, ["doc_id"]), remainder(5) == 0)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import neighbours

    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import mixing

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_position")
    return mixing.range_sorted(mixed, "first_position")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import clusters

    return clusters.cluster(_table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import simhash

    return simhash.components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"pipeline": pipeline}


OP1_SQL = r"""
WITH lowered AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM items, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) AS u(i)),
lengths AS (SELECT DISTINCT n FROM windows),
found AS (SELECT r, item_id, i, l.n FROM lowered, lengths l, unnest(range(1, greatest(len(w) - l.n + 1, 0) + 1)) AS u(i)
  JOIN windows p ON p.n = l.n AND p.phrase = array_to_string(w[i:i + l.n - 1], ' ')),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) AS v(j) GROUP BY r),
of_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN hit USING (r) LEFT JOIN of_items USING (r)
"""


OP6_SQL = r"""
WITH RECURSIVE split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM split, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS u(i)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach(r, t) AS (SELECT r, r FROM split UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.t)
SELECT s.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM split s LEFT JOIN sizes USING (r) JOIN reach USING (r) JOIN split o ON o.r = reach.t GROUP BY s.r, s.doc_id
"""


def _op11_sql(rounds: int = 10, k: int = 8) -> str:
    """Whole numbers below 2**53 throughout, which DOUBLE holds exactly."""
    steps = [
        """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, x, list_dot_product(x, x) AS xx FROM (
  SELECT vec_id, [floor(1024 * CAST(e AS DOUBLE)) FOR e IN embedding] AS x FROM embeddings WHERE len(embedding) = 64 AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, x, xx FROM v QUALIFY j < %d)"""
        % k
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min((v.xx - 2 * list_dot_product(v.x, c.x) + c.xx, c.j)) AS near FROM v, c{n} c GROUP BY r)")
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT j, x, list_dot_product(x, x) AS xx FROM (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
  SELECT j, list(floor(s / n) ORDER BY i) AS x FROM (SELECT near[2] AS j, i, sum(x[i]) AS s, count(*) AS n FROM a{n}, unnest(range(1, 65)) AS u(i) GROUP BY ALL) GROUP BY j) m USING (j)))"""
            )
    steps.append(f"f AS (SELECT vec_id, near[2] AS j, CAST(near[1] AS BIGINT) AS distance FROM a{rounds})")
    return (
        ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(f.j AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string([CAST(CAST(e AS BIGINT) AS VARCHAR) FOR e IN c.x], ',')) AS centroid_sha256
FROM f JOIN c{rounds} c USING (j)"""
    )


OP13_SQL = r"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(e AS DOUBLE)) FOR e IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth FROM s WHERE alike QUALIFY nth <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.r, nth ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (r) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op6_ngram_join": OP6_SQL, "op11_clusters": _op11_sql(), "op13_hard_negatives": OP13_SQL}
