"""The queries of the operators: each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, decontamination, html_text, license_scan, quality_classifier, quality_rules, simhash_dedup, token_files, toxicity, url_filter
from lectern.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, docs, table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(token_files.VOCABULARY))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, docs, table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(byte_bpe.VOCABULARY))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(table(spark, sf_dir, "pages"))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 4: the statistics and the base rule."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 10: host, path and rule, with the verdict where a rule fits."""
    return op10_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_html_text, op3_simhash_dedup, op4_quality_rules, op5_decontamination, op6_quality_classifier, op7_token_files, op8_toxicity, op9_byte_bpe, op10_url_filter,
        quality_statistics, url_rules,
    )
}
WORD = "[^\\x20\\x09-\\x0D]"
LONGEST_FIRST = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
FITS = {h + p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in LONGEST_FIRST}
ORACLE_SQL: dict[str, str] = {
    "quality_statistics": (
        f"WITH d AS (SELECT row_number() OVER () AS k, doc_id, COALESCE(text, '') AS text FROM documents), s AS (SELECT *, regexp_extract_all(text, '{WORD}+') AS ws FROM d), "
        "w AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s), t AS (SELECT k, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS x FROM w WINDOW o AS (PARTITION BY k ORDER BY i)), "
        "m AS (SELECT *, count(*) OVER (PARTITION BY k, x) AS n FROM t WHERE x IS NOT NULL), c AS (SELECT DISTINCT k, i + unnest([0, 1, 2]) AS i FROM m WHERE n > 1), r AS (SELECT k, count(*) AS n FROM c GROUP BY k), "
        f"l AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d) "
        "SELECT doc_id, len(ws) AS n_words, CAST(COALESCE(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, "
        "len(ls) - len(list_distinct(ls)) AS n_dup_lines, COALESCE(r.n, 0) AS n_repeat_words, len(ws) < 50 OR 100 * COALESCE(r.n, 0) > 50 * len(ws) AS base_failed FROM s JOIN l ON s.k = l.k LEFT JOIN r ON s.k = r.k"
    ),
    "url_rules": (
        "WITH u AS (SELECT page_id, translate(COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages) "
        "SELECT page_id, host, path, CASE " + " ".join(f"WHEN {fits} THEN '{rule}'" for rule, fits in FITS.items()) + " END AS rule, CASE " + " ".join(f"WHEN {FITS[h + p]} THEN '{v}'" for h, p, v in LONGEST_FIRST) + " END AS ruled FROM u"
    ),
}
