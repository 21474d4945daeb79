"""The registered queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fingerprints, html_extract, license_scan, line_dedup, packing, quality_rules, simhash, token_counts, url_filter

#: Names the folder of vocabulary files, where it isn't the usual one.
TOKENIZERS = "SYMDEX_TOKENIZERS"

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer(name: str) -> str:
    """A vocabulary file; every executor has the same folder."""
    return os.path.join(os.environ.get(TOKENIZERS, "/opt/tokenizers"), name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.keep(_read(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), decoded=True)


def op8_simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.pairs(_read(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.equal_groups(_read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_line_dedup, op2_url_filter, op3_token_counts, op4_license_scan, op5_html_text, op6_quality_rules, op7_byte_bpe, op8_simhash_pairs, op9_fingerprints, op10_best_fit_packing
    )}


_LINES = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
), marked AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS blank, row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS k FROM lines
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (k = 1 OR blank) AS new, bool_or(k > 1 AND NOT blank) AS lost, bool_or(k = 1 AND NOT blank) AS rest FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN lost THEN new ELSE d.text END AS text, d.lang, d.source, CASE WHEN lost THEN length(new) ELSE d.n_chars END AS n_chars
FROM documents d LEFT JOIN kept USING (doc_id) WHERE NOT coalesce(lost AND NOT rest, false)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _LINES, "op4_license_scan": license_scan.oracle(), "op6_quality_rules": quality_rules.oracle(), "op9_fingerprints": fingerprints.oracle()}
