"""The operators as queries over the whole tables, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsift.llm import centroids, html, mixing, pieces, quality, resampling, sharding, simhash, token_counts, topk, toxicity, urls, vectors
from fleetsift.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.duplicates(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a capture, and every page also yields one dated entry about its URL, host or domain."""
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id")

    def after(factor: int, shift: int):
        return F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(n * factor + shift, F.lit(31_536_000)))

    names = urls.host(F.col("url"))
    kind = F.element_at(F.array(F.lit("url"), F.lit("host"), F.lit("domain")), (F.pmod(n, F.lit(3)) + 1).cast("int"))
    entries = pages.select(
        F.when(F.pmod(n, F.lit(2)) == 0, "a").otherwise("b").alias("list"), kind.alias("kind"),
        F.when(kind == "url", urls.plain(F.col("url"))).when(kind == "host", names).otherwise(F.substring_index(names, ".", -3)).alias("value"),
        F.when(F.pmod(n, F.lit(5)) == 0, "allow").otherwise("block").alias("verdict"),
        F.when(F.pmod(F.floor(n / 7), F.lit(3)) == 0, "remove").otherwise("add").alias("action"), after(7_919_333, 13).alias("at"))
    captures = pages.select("page_id", "url", after(1_047_293, 0).alias("fetched_at"))
    told = urls.filter_urls(captures, entries)
    return told.withColumns({c: F.unix_seconds(c) for c in ("fetched_at", "valid_from", "valid_to")})


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, url, 1704067200 + (page_id * 1047293) % 31536000 AS fetched_at, 1704067200 + (page_id * 7919333 + 13) % 31536000 AS listed,
         nullif(rtrim(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\\\s]+)', 1), '.'), '') AS host,
         regexp_replace(trim(url), '#.*$', '') AS plain
  FROM pages),
e AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS list, CASE page_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'host' ELSE 'domain' END AS kind,
         CASE page_id % 3 WHEN 0 THEN plain WHEN 1 THEN host ELSE array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') END AS value,
         CASE WHEN (page_id // 7) % 3 = 0 THEN 0 WHEN page_id % 5 = 0 THEN 1 ELSE 2 END AS state, listed
  FROM p),
m AS (SELECT list, kind, value, listed, max(state) AS state FROM e GROUP BY ALL),
c AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY list, kind, value ORDER BY listed), 0) AS was FROM m),
k AS (SELECT * FROM c WHERE state <> was),
s AS (SELECT list, kind, value, state, listed AS valid_from, lead(listed) OVER (PARTITION BY list, kind, value ORDER BY listed) AS valid_to FROM k),
h AS (
  SELECT p.page_id, s.*, row_number() OVER (PARTITION BY p.page_id ORDER BY
           CASE s.kind WHEN 'url' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(s.value) DESC, s.state, s.list) AS place
  FROM p JOIN s ON s.state > 0 AND p.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR p.fetched_at < s.valid_to)
    AND CASE s.kind WHEN 'url' THEN p.plain = s.value WHEN 'host' THEN p.host = s.value
             ELSE p.host = s.value OR ends_with(p.host, '.' || s.value) END)
SELECT p.page_id, p.url, p.fetched_at, coalesce(h.state = 2, false) AS blocked, h.list, h.kind, h.value, h.valid_from, h.valid_to
FROM p LEFT JOIN h ON h.page_id = p.page_id AND h.place = 1
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.counts(docs.select("doc_id", "text", token_counts.edits_of(F.col("text")).alias("edits")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors_ = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors_.filter(F.col("vec_id") % 50 == 0), vectors_)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = quality.learned_words(docs)
    return quality.quality(docs, words, quality.fit(docs, table(spark, sf_dir, "labels"), words))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


_FINE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP3_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE {_FINE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
"""

OP7_SQL = f"""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE {_FINE}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM t WHERE rank <= 5
"""


def _op13_sql(rounds: int = 10) -> str:
    """Vectors and centroids as one row per component, a round after the other."""
    def nearest(i: int) -> str:
        return f"""
d{i} AS MATERIALIZED (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c USING (i) GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT r, d, c FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""

    steps = [nearest(0)]
    for i in range(1, rounds + 1):
        steps.append(f"""
m{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{i - 1} JOIN v USING (r) GROUP BY ALL),
c{i} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
                      FROM c{i - 1} LEFT JOIN m{i} USING (c, i)),{nearest(i)}""")
    return f"""
WITH q AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE {_FINE} AND len(embedding) = 64),
v AS MATERIALIZED (SELECT r, unnest(q) AS x, unnest(range(64)) AS i FROM q),
o AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) - 1 AS c FROM q),
c0 AS MATERIALIZED (SELECT c, i, x FROM o JOIN v USING (r) WHERE c < 8),
{",".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN q USING (r) JOIN h USING (c)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_toxicity, op2_mixing, op3_embedding_duplicates, op4_url_filter, op5_token_counts, op6_simhash, op7_top_k, op8_sharding, op9_sentencepiece,
    op10_html, op11_resampling, op12_quality, op13_centroids)}
ORACLES = {"op3_embedding_duplicates": OP3_SQL, "op4_url_filter": OP4_SQL, "op7_top_k": OP7_SQL, "op13_centroids": _op13_sql()}
