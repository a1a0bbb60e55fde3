"""The queries of this subpackage's operators and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import click_dedup, license_scan, mixing, ngram_join, packing, periodic_runs, pii, quality_rules, suffix_dedup, token_output, toxicity, url_filter, vector_search
from .common import read_table

ALLOW = [("org", "/"), ("com", "/fr/")]
BLOCK = [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/")]


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), length=2048, with_ids=False)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), max_epochs=3)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(read_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), ALLOW, BLOCK)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("span_edges")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_output.write_ids(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return token_output.read_ids(spark, manifest, with_ids=False)


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs, quality_rules.fit(docs, read_table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("spans")


def op12_click_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = click_dedup.copies(read_table(spark, sf_dir, "clicks"), 12)
    return click_dedup.windows(copies, 12, horizon=72, lateness=48).withColumn("hash", F.lower(F.hex("hash")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find(read_table(spark, sf_dir, "documents"), least=12, fold=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_pii, op3_mixing, op4_ngram_join, op5_url_filter, op6_suffix_dedup, op7_token_output, op8_vector_search, op9_toxicity, op10_quality_rules, op11_license_scan, op12_click_dedup, op13_periodic_runs)
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP3 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 3 * source_size AS bound FROM s),
t AS (SELECT sum(source_size)::BIGINT AS total FROM s),
fill AS (
  SELECT 0 AS step, (SELECT total::DOUBLE FROM t) / sum(weight) AS level FROM w
  UNION ALL
  SELECT step + 1, (SELECT ((SELECT total FROM t) - coalesce(sum(bound) FILTER (bound <= fill.level * weight), 0))::DOUBLE / nullif(sum(weight) FILTER (bound > fill.level * weight), 0) FROM w)
  FROM fill WHERE level IS NOT NULL AND step < (SELECT count(*) FROM w)),
top AS (SELECT max(level) AS level FROM fill),
a AS (SELECT w.*, CASE WHEN bound <= level * weight THEN bound::DOUBLE ELSE level * weight END AS target FROM w, top),
p AS (
  SELECT d.*, a.source_size, a.target, floor(a.target + 0.5)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(greatest(budget - (budget // source_size) * source_size - before, 0), size) END::BIGINT AS taken
FROM p
"""

_OP4 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS start, doc_id AS node FROM w UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.node),
m AS (SELECT start, min(node) AS component_id FROM r GROUP BY start)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM w JOIN m ON m.start = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

_OP5 = """
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT u.*, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, rule_host) AS k
  FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""

_OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": _OP3, "op4_ngram_join": _OP4, "op5_url_filter": _OP5, "op8_vector_search": _OP8}
