"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import fingerprints, jaccard_join, language, line_dedup, lm_scoring, mixing, packing, secrets, topk, url_filter
from quayside.llm.common import table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", url_filter.fetched_of(F.col("page_id")).alias("fetched"))
    return url_filter.filter_captures(captures, url_filter.list_of(pages))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), whole=True)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_corpus(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_filter": op3_url_filter,
    "op4_fingerprints": op4_fingerprints,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mix_sources": op9_mix_sources,
    "op10_exact_top_k": op10_exact_top_k,
}

ORACLE_SQL = {
    "op3_url_filter": r"""
WITH n AS (SELECT page_id, url, replace(url, '\', '/') AS u, row_number() OVER () AS r FROM pages),
a AS (
  SELECT *, CASE WHEN regexp_matches(u, '^[\x00-\x20]*([A-Za-z][-A-Za-z0-9.+]*:)?//') THEN substr(u, strpos(u, '//') + 2) END AS rest FROM n),
b AS (SELECT *, string_split(string_split(string_split(rest, '/')[1], '?')[1], '#')[1] AS authority FROM a),
e AS (SELECT *, string_split(authority, '@')[-1] AS after FROM b),
f AS (SELECT *, CASE WHEN starts_with(after, '[') AND contains(after, ']') THEN split_part(after, ']', 1) || ']' ELSE split_part(after, ':', 1) END AS raw FROM e),
g AS (SELECT *, lower(CASE WHEN contains(raw, '%') THEN url_decode(raw) ELSE raw END) AS low FROM f),
h AS (SELECT *, CASE WHEN starts_with(low, 'www.') THEN substr(low, 5) ELSE low END AS bare FROM g),
c AS (
  SELECT page_id, url, r, DATE '2024-01-01' + CAST(((page_id * 37) % 366 + 366) % 366 AS INTEGER) AS fetched,
    nullif(CASE WHEN ends_with(bare, '.') THEN left(bare, -1) ELSE bare END, '') AS host,
    string_split(string_split(substr(rest, len(authority) + 1), '?')[1], '#')[1] AS path
  FROM h),
p AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps FROM c WHERE host IS NOT NULL),
k AS (
  SELECT DISTINCT r, 'h:' || array_to_string(labels[i:], '.') AS key FROM (SELECT r, labels, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM p)
  UNION SELECT r, 'p:' || host || '/' || array_to_string(steps[:i], '/') FROM (SELECT r, host, steps, unnest(range(1, len(steps) + 1)) AS i FROM p)),
own AS (
  SELECT 'h:' || host AS key FROM p UNION SELECT 'p:' || host || '/' || s FROM (SELECT host, steps[1] AS s FROM p) WHERE s <> ''),
m AS (
  SELECT key, CAST('0x' || substr(md5(key), 1, 2) AS INTEGER) AS a, DATE '2024-01-01' + CAST('0x' || substr(md5(key), 3, 2) AS INTEGER) AS d,
    CAST('0x' || substr(md5(key), 5, 2) AS INTEGER) AS c FROM own),
spans AS (
  SELECT key, d AS f, CASE WHEN c < 128 THEN d + 60 END AS t FROM m WHERE a < 64
  UNION ALL SELECT key, d + 150, NULL FROM m WHERE a < 64 AND c < 64),
hits AS (SELECT k.r, k.key FROM k JOIN c USING (r) JOIN spans s ON s.key = k.key AND s.f <= c.fetched AND (s.t IS NULL OR c.fetched < s.t))
SELECT page_id, url, host, fetched, CAST(count(h.key) AS BIGINT) AS n_active, min(h.key) AS matched, count(h.key) > 0 AS blocked
FROM c LEFT JOIN hits h USING (r) GROUP BY r, page_id, url, host, fetched""",
    "op9_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(length(text), 0) AS chars,
    (CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
k AS (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size,
    -ln(u) / greatest(CAST(0.1 AS DOUBLE), 1.0 - abs(CAST(chars AS DOUBLE) / CAST(greatest(size, 1) AS DOUBLE) - CAST(6 AS DOUBLE)) / CAST(10 AS DOUBLE)) AS key FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r FROM k GROUP BY source),
c AS (
  SELECT *, 2 * total AS cap, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
o AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS level, sum(cap) OVER x AS caps, sum(w) OVER x AS ws, sum(w) OVER () AS all_w,
    CAST(sum(total) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS goal
  FROM c WINDOW x AS (ORDER BY CAST(cap AS DOUBLE) / w, r ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, level <= (goal - CAST(caps - cap AS DOUBLE)) / CAST(all_w - (ws - w) AS DOUBLE) AS full_ FROM o),
g AS (SELECT *, coalesce(max(caps) FILTER (full_) OVER (), 0) AS kc, coalesce(max(ws) FILTER (full_) OVER (), 0) AS kw FROM f),
t AS (
  SELECT source, total, CASE WHEN ws <= kw THEN CAST(cap AS DOUBLE) ELSE w * ((goal - CAST(kc AS DOUBLE)) / CAST(all_w - kw AS DOUBLE)) END AS target FROM g),
e AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target) AS BIGINT) // total ELSE 0 END AS epochs FROM t)
SELECT doc_id, size, total AS source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * total
    - (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size))) AS BIGINT) AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source""",
    "op10_exact_top_k": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
