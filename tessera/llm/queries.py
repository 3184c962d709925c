"""The queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, minhash, mixing, pii, quality_classifier, quality_rules, suffix_dedup, url_filter, warc
from .common import table

#: Fixed values of the URL filter's query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: The key of the PII query; in production it is a secret of the caller's.
PII_KEY = "tessera"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_counts(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
}

_LOWERED = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path) * 1000 + length(rule_host)) AS rule,
         max_by(rule_verdict, length(rule_host || rule_path) * 1000 + length(rule_host)) AS verdict
  FROM parts, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
""",
    "op7_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
         min(page_id) OVER (PARTITION BY hex) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM d
""",
    "op9_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows))
), hits AS (
  SELECT doc_id, n, p, item FROM places JOIN windows USING (n, s)
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""" % (_LOWERED.format("text"), _LOWERED.format("text")),
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, p - 1 AS pos, l[p] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), full_lines AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT a.doc_id, a.pos AS a0, b.pos AS a1, c.pos AS a2, a.line || chr(10) || b.line || chr(10) || c.line AS w
  FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN full_lines c ON a.doc_id = c.doc_id AND c.i = a.i + 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, a0) AS n FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest([a0, a1, a2]) AS pos FROM ranked WHERE n > 1
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
), counts AS (
  SELECT g.doc_id, count(*) AS n_removed, count(*) FILTER (h.pos IS NULL) AS n_spans FROM gone g LEFT JOIN gone h ON g.doc_id = h.doc_id AND h.pos = g.pos - 1 GROUP BY g.doc_id
), totals AS (
  SELECT doc_id, count(*) AS n_lines FROM full_lines GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN totals USING (doc_id)
""",
}
