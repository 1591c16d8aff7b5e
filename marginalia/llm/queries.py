"""The registered queries: thin applications of the operators to whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.centroids import CLUSTERS, ROUNDS, cluster_vectors
from marginalia.llm.decontamination import contamination
from marginalia.llm.divergence import source_divergence
from marginalia.llm.extraction import extract_pages
from marginalia.llm.language import fold, identify, learn
from marginalia.llm.ngram_join import link_documents
from marginalia.llm.packing import pack_documents
from marginalia.llm.quality import quality_scores
from marginalia.llm.registry import ORACLE, QUERIES, query, table  # noqa: F401
from marginalia.llm.sharding import shard_documents
from marginalia.llm.substring_dedup import repeated_passages
from marginalia.llm.token_counts import count_tokens
from marginalia.llm.token_files import read_token_files, write_token_files
from marginalia.llm.vector_dedup import near_vectors
from marginalia.session import checkpoint_dir

SHARDS = 40


@query("op1_substring_dedup")
def substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return repeated_passages(table(spark, directory, "documents")).drop("cuts", "text_hash")


DECONTAMINATION_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
hits AS (
  SELECT p.doc_id, p.i, p.size, windows.item_id
  FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words), sizes WHERE i + size - 1 <= len(w)) p
  JOIN windows ON windows.words = p.words AND windows.size = p.size),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_benchmark_decontamination", DECONTAMINATION_SQL)
def benchmark_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return contamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return pack_documents(table(spark, directory, "documents"))


@query("op4_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    return link_documents(table(spark, directory, "documents"))


@query("op5_language_id")
def language_id(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text", "lang")
    net = learn(docs.where(fold("doc_id", 4) != 2))
    guessed = identify(docs.select("doc_id", "text"), net)
    return guessed.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op6_quality_classifier")
def quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    docs, labels = table(spark, directory, "documents"), table(spark, directory, "labels")
    scored = quality_scores(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op7_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return near_vectors(table(spark, directory, "embeddings"))


@query("op8_html_extraction")
def html_extraction(spark: SparkSession, directory: str) -> DataFrame:
    return extract_pages(table(spark, directory, "pages"))


@query("op9_sharding")
def sharding(spark: SparkSession, directory: str) -> DataFrame:
    placed = shard_documents(table(spark, directory, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_token_files")
def token_files(spark: SparkSession, directory: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(spark, write_token_files(table(spark, directory, "documents"), folder))


def _clustering_sql() -> str:
    """Every round as three steps: distances, nearest centroids, floors of the means."""
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, k, d FROM (SELECT r, k, sum((v - c) * (v - c)) AS d FROM x JOIN c{n} USING (j) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if n < ROUNDS:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (SELECT k, j, coalesce(m, c) AS c FROM c{n} LEFT JOIN (
  SELECT k, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
  FROM (SELECT k, j, sum(v) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY k, j)) USING (k, j))""")
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
x AS MATERIALIZED (SELECT r, j, CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT r, unnest(range(64)) AS j, unnest(embedding) AS y FROM e)),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM e QUALIFY k < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT k, j, v AS c FROM first JOIN x USING (r)),{",".join(steps)},
h AS (SELECT k, sha256(string_agg(c, ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN e USING (r) JOIN h USING (k)"""


@query("op11_centroid_clustering", _clustering_sql())
def centroid_clustering(spark: SparkSession, directory: str) -> DataFrame:
    return cluster_vectors(table(spark, directory, "embeddings"))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM w GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(o.n, 0) AS n, kept.n AS of_lang FROM g JOIN kept USING (lang)
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM w GROUP BY ALL) o ON o.lang = g.lang AND o.source = g.source AND o.term = kept.term),
p AS MATERIALIZED (SELECT lang, source, term, c.n, CAST(1 + 1000000000::HUGEINT * (c.n + 2) // (sum(c.n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p,
  CAST(1 + 1000000000::HUGEINT * (of_lang + 2) // (total + 2 * v) AS BIGINT) AS q FROM c JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def divergence(spark: SparkSession, directory: str) -> DataFrame:
    return source_divergence(table(spark, directory, "documents"))


@query("op13_token_counts")
def token_counts(spark: SparkSession, directory: str) -> DataFrame:
    return count_tokens(table(spark, directory, "documents"))
