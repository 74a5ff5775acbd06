"""One query per operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineax.llm import centroids, html_text, importance, jaccard, line_dedup, mixing, packing, pieces, quality, secrets, training_order, urls, vectors
from lineax.llm.common import table
from lineax.session import scratch_path

#: Host and path rules of the url query.
URL_RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]
ORDER_KEY = 0x5EED


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.dedup_lines(docs, report=True).select("doc_id", "n_lines_removed", F.md5("text").alias("text_md5"))


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op4_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("found")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op7_projection_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_components(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise_training_order(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"), key=ORDER_KEY)


def op10_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def op11_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance.importance_sample(docs, target, carry=["doc_id"], most=1, buckets=10_000, share=(10, 100), min_words=20, seed=2024)


def op13_ns_bounds_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64.0, seed=1)
    return centroids.with_cluster_sums(rows.drop("n_evaluated"), found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_source_mix, op2_line_dedup, op3_tokeniser_fertility, op4_url_equivalence, op5_secret_novelty, op6_sentencepiece, op7_projection_collisions, op8_partenum_jaccard, op9_training_order, op10_block_rules,
                                  op11_grouped_packing, op12_importance_resampling, op13_ns_bounds_clusters)}

_W = r"[^\x20\x09-\x0D]+"
_F = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _clusters_sql(rounds: int) -> str:
    """Plain k-means: every distance in every round, on (vector, position, component) rows."""
    def assign(r: int) -> str:
        return f"""a{r} AS (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM
  (SELECT vec_id, cluster, sum((x - y) * (x - y))::BIGINT AS d FROM v JOIN c{r} USING (pos) GROUP BY vec_id, cluster) GROUP BY vec_id)"""

    def move(r: int) -> str:
        return f"""c{r + 1} AS (SELECT c.cluster, c.pos, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN
  (SELECT cluster, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS y FROM a{r} JOIN v USING (vec_id) GROUP BY cluster, pos) m USING (cluster, pos))"""

    steps = ",\n".join(f"{assign(r)},\n{move(r)}" for r in range(rounds))
    return f"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT vec_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM kept),
named AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS cluster FROM kept),
c0 AS (SELECT cluster, pos, x AS y FROM v JOIN named USING (vec_id) WHERE cluster < 16),
{steps},
{assign(rounds)},
names AS (SELECT cluster, sha256(string_agg(y::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN names USING (cluster)"""


ORACLE: dict[str, str] = {
    "op1_source_mix": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_W}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
step(n, level) AS (SELECT 0, 0.0::DOUBLE UNION ALL
  SELECT n + 1, (SELECT (1.5::DOUBLE * sum(source_size) - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (2.0::DOUBLE * source_size <= step.level * weight), 0))
    / nullif(sum(weight) FILTER (NOT 2.0::DOUBLE * source_size <= step.level * weight), 0) FROM w) FROM step WHERE level IS NOT NULL AND n < 200),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT max(level) FROM step) * weight) AS target FROM w),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('29|' || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
    "op2_line_dedup": rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT *, CASE WHEN regexp_matches(raw, '{_W}') THEN regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') END AS line FROM l),
wide AS (SELECT line FROM w WHERE line IS NOT NULL GROUP BY line HAVING count(DISTINCT source) + bool_or(source IS NULL)::INT >= 5),
judged AS (SELECT doc_id, raw, pos, line IN (SELECT line FROM wide) AND line IS NOT NULL AS goes, line IS NOT NULL AS counts FROM w),
mixed AS (SELECT doc_id, count(*) FILTER (goes) AS gone, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT goes), '') AS kept
  FROM judged GROUP BY doc_id HAVING bool_or(goes) AND bool_or(counts AND NOT goes))
SELECT d.doc_id, coalesce(gone, 0)::BIGINT AS n_lines_removed, md5(coalesce(kept, d.text)) AS text_md5 FROM documents d LEFT JOIN mixed USING (doc_id)""",
    "op4_url_equivalence": r"""
WITH RECURSIVE rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
links AS (SELECT url AS src, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b([^>]*)>', 1), lambda a: regexp_matches(a, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')), lambda a: regexp_extract(a, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b([^>]*)>', 1), lambda a: regexp_matches(a, '(?is)\bhttp-equiv\s*=\s*["'']?refresh')), lambda a: regexp_extract(a, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1)))) AS dst
  FROM pages WHERE contains(url, '://')),
ends AS (SELECT src, dst FROM links WHERE contains(dst, '://')),
u AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT src FROM ends UNION ALL SELECT dst FROM ends)),
k AS (SELECT url, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(url, '^.*?://[^?#]*(\?[^#]*)', 1, 's') AS query FROM u WHERE url IS NOT NULL),
j AS (SELECT k.url, host, path, CASE WHEN host <> '' THEN host || path || query END AS node, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM k LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM ends JOIN j a ON a.url = src JOIN j b ON b.url = dst WHERE a.node <> b.node),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT r.a, y.b FROM reach r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) y ON r.b = y.a),
alias AS (SELECT reach.a AS node, CASE WHEN bool_or(action = 'allow') THEN 'allow' WHEN bool_or(action = 'block') THEN 'block' END AS verdict FROM reach JOIN j ON j.node = reach.b GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, alias.verdict, 'allow') AS verdict
FROM pages LEFT JOIN j USING (url) LEFT JOIN alias USING (node)""",
    "op12_importance_resampling": rf"""
WITH RECURSIVE steps(i, c, n) AS (SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
raw AS (SELECT doc_id, unnest({_F}) AS word FROM documents), aim AS (SELECT unnest({_F}) AS word FROM benchmark),
vocabulary AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM raw UNION SELECT word FROM aim)),
named AS (SELECT word, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda k: ('0x' || x[2 * k + 1 : 2 * k + 2])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), {0xFFFFFFFF}::BIGINT), {0xFFFFFFFF}) % 10000 AS bucket
  FROM vocabulary, tab),
s AS (SELECT bucket, count(*) AS s FROM raw JOIN named USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM aim JOIN named USING (word) GROUP BY bucket),
gains AS (SELECT range AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM raw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aim) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range),
weighed AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM raw JOIN named USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
    "op13_ns_bounds_clusters": _clusters_sql(rounds=3),
}
