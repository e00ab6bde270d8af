"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from heatloom.llm import (
    attention_lm, bisector_kmeans, budget_mix, chat_rotation, graph_ann, itq_dedup, length_buckets, nb_toxicity, pairwise_quality, partenum,
    prefix_tokens, qd_whitening, warc,
)
from heatloom.llm.common import table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS = (5.0, 2.0, 1.0), 1.5, 2.0
BUCKETS, TOKEN_BUDGET = 8, 65536


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


LINK_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e,
                  label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
pairs AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND a.fine AND b.fine
          AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE false END),
reach AS (SELECT r, r AS t FROM v UNION SELECT x.r, p.b FROM reach x JOIN pairs p ON p.a = x.t),
least AS (SELECT x.r, min(w.vec_id) AS component_id FROM reach x JOIN v w ON w.r = x.t GROUP BY x.r),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN least USING (r)
"""


@query("op1_itq_dedup", LINK_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_pairwise_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pairwise_quality.quality_scores(docs, pairwise_quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op3_partenum_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_classes(table(spark, sf_dir, "documents"))


ROTATE_SQL = f"""
WITH said AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, role, coalesce(text, '') AS content FROM conversations),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(coalesce(length(role) || ':' || role, '-:') || content)) - 1 AS pos FROM said),
speakers AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM said WHERE role IS NOT NULL AND role <> 'system'),
views AS (
  SELECT conv_id, speaker, pos // {chat_rotation.PART_TURNS} AS part, pos, content, coalesce(role = speaker, false) AS own,
         CASE WHEN coalesce(role = speaker, false) THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
              ELSE '<|user name=' || coalesce(role, '{chat_rotation.NOBODY}') || '|>' END || chr(10) AS head
  FROM numbered JOIN speakers ON conv_id IS NOT DISTINCT FROM c),
placed AS (
  SELECT *, sum(length(head) + length(content) + 1) OVER (
      PARTITION BY conv_id, speaker, part ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stop FROM views)
SELECT conv_id, speaker, part, count(*) AS n_messages, count(*) FILTER (own) AS n_own,
       string_agg(head || content || chr(10), '' ORDER BY stop) AS text,
       coalesce(string_agg(CAST(stop - length(content) - 1 AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY stop) FILTER (own), '') AS spans
FROM placed GROUP BY conv_id, speaker, part
"""


@query("op4_perspective_rotation", ROTATE_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat_rotation.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.zip_with("mask_starts", "mask_ends", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string")))
    return views.select("conv_id", "speaker", "part", "n_messages", "n_own", "text", F.array_join(spans, ",").alias("spans"))


NEAREST_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op5_graph_ann")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def pack_sql(buckets: int, budget: int) -> str:
    """The dynamic programme as one layer of common table expressions for each bucket."""
    bits = length_buckets.EXACT_BITS
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    step = f"(1::BIGINT << greatest(length(bin(n_tokens)) - {bits}, 0)::BIGINT)"
    layers = [
        "f1 AS (SELECT j, top * n - s AS f, 0::BIGINT AS i FROM h WHERE j >= 1)",
    ]
    for k in range(2, buckets + 1):
        layers.append(
            f"f{k} AS (SELECT b.j, min(a.f + b.top * (b.n - x.n) - (b.s - x.s)) AS f, "
            f"arg_min(x.j, (a.f + b.top * (b.n - x.n) - (b.s - x.s), x.j)) AS i "
            f"FROM h b JOIN h x ON x.j < b.j JOIN f{k - 1} a ON a.j = x.j WHERE b.j >= {k} GROUP BY b.j)")
    layers.append(f"start AS (SELECT max(j) AS j, least(max(j), {buckets}) AS k FROM h)")
    layers.append("c0 AS (SELECT j, k FROM start WHERE j > 0)")
    alls = " UNION ALL ".join(f"SELECT {k} AS k, j, i FROM f{k}" for k in range(1, buckets + 1))
    layers.append(f"f AS ({alls})")
    for k in range(1, buckets):
        layers.append(f"c{k} AS (SELECT f.i AS j, c.k - 1 AS k FROM c{k - 1} c JOIN f ON f.k = c.k AND f.j = c.j WHERE f.i > 0)")
    ends = " UNION ".join(f"SELECT j FROM c{k}" for k in range(buckets))
    return f"""
WITH sized AS (SELECT doc_id, {words}::BIGINT AS n_tokens, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
g AS (SELECT (ceil(n_tokens / {step}) * {step})::BIGINT AS top, count(*) AS c FROM sized GROUP BY 1),
h AS (SELECT row_number() OVER (ORDER BY top) AS j, top, sum(c) OVER (ORDER BY top)::BIGINT AS n,
             sum(c * top) OVER (ORDER BY top)::BIGINT AS s FROM g
      UNION ALL SELECT 0, 0, 0, 0),
{", ".join(layers)},
ends AS (SELECT h.top AS pad_to FROM ({ends}) e JOIN h USING (j)),
placed AS (SELECT doc_id, n_tokens, key, (SELECT min(pad_to) FROM ends WHERE pad_to >= n_tokens) AS pad_to FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pad_to ORDER BY key, n_tokens) - 1 AS r,
                  greatest(1, {budget} // greatest(pad_to, 1)) AS m FROM placed)
SELECT doc_id, n_tokens, pad_to, r // m AS batch, r % m AS slot FROM ranked
"""


@query("op6_length_buckets", pack_sql(BUCKETS, TOKEN_BUDGET))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.pack_documents(table(spark, sf_dir, "documents"), word_count(F.col("text")), BUCKETS, TOKEN_BUDGET)


@query("op7_nb_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nb_toxicity.toxicity_scores(docs, nb_toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def tokenizer_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query("op8_prefix_tokens")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_bytes())


@query("op9_attention_lm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.language_scores(table(spark, sf_dir, "documents"), tokenizer_bytes())


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM src),
lv AS (SELECT *, (sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE
                  - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                 / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
target AS (SELECT source, source_size, least(cap, max(lv) OVER () * w) AS target FROM lv),
plan AS (SELECT source AS s, source_size, target, floor(target)::BIGINT AS budget,
                CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM target),
run AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS before FROM sized)
SELECT doc_id, size, source_size, target,
       (size * whole + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken
FROM run JOIN plan ON source IS NOT DISTINCT FROM s
"""


@query("op10_budget_mix", MIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = budget_mix.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").cast("long").alias("taken"))


@query("op11_qd_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qd_whitening.whiten(table(spark, sf_dir, "embeddings"))


WARC_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
n AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
             row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS k,
             first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS lead FROM p),
m AS (SELECT *, payload_bytes >= {warc.LEAST_BYTES} AND k > 1 AS later FROM n)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN later THEN lead END AS refers_to FROM m
"""


@query("op12_warc_reader", WARC_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages")).drop("payload")


def kmeans_sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2") -> str:
    """The rounds as one layer of common table expressions each."""
    fine = f"embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
    layers = [f"""
kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
         FROM embeddings WHERE CASE WHEN {fine} THEN true ELSE false END),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS cluster, x AS c
       FROM kept QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        layers.append(f"""
d{i} AS (SELECT r, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept, c{i}),
a{i} AS (SELECT r, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{i} GROUP BY r)""")
        if i < rounds:
            layers.append(f"""
s{i} AS (SELECT cluster, i, sum(v) AS s, count(*) AS n
         FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM kept JOIN a{i} USING (r)) GROUP BY cluster, i),
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{i} GROUP BY cluster),
c{i + 1} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return f"""
WITH {",".join(layers)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (cluster)
"""


@query("op13_bisector_kmeans", kmeans_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector_kmeans.bisector_kmeans(table(spark, sf_dir, "embeddings"))
