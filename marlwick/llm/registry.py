"""Queries of the training-data operators, and SQL for those that have a SQL form."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, language_id, line_dedup, packing, secrets, simhash, token_counts, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_roundtrip(_table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_warc_revisits, op3_url_filter, op4_decontaminate, op5_secrets, op6_line_dedup,
              op7_simhash, op8_packing, op9_token_counts, op10_language_id)
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op2_warc_revisits": """
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
               CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
        FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))""",
    "op6_line_dedup": """
        WITH lines AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
        ), places AS (
            SELECT doc_id, l, unnest(range(len(l) - 2)) AS line FROM lines WHERE len(l) >= 3
        ), windows AS (
            SELECT doc_id, line, l[line + 1] || chr(10) || l[line + 2] || chr(10) || l[line + 3] AS w FROM places
            WHERE trim(l[line + 1]) <> '' OR trim(l[line + 2]) <> '' OR trim(l[line + 3]) <> ''
        ), later AS (
            SELECT doc_id, line FROM (
                SELECT doc_id, line, row_number() OVER (PARTITION BY w ORDER BY doc_id, line) AS r FROM windows) WHERE r > 1
        ), removed AS (
            SELECT doc_id, list(DISTINCT line + d) AS gone FROM later, (VALUES (0), (1), (2)) AS v(d) GROUP BY doc_id
        )
        SELECT lines.doc_id, len(l) AS n_lines, coalesce(len(gone), 0) AS n_removed,
               CASE WHEN gone IS NULL THEN text ELSE array_to_string(
                   [l[i + 1] FOR i IN range(len(l)) IF NOT list_contains(gone, i)], chr(10)) END AS text
        FROM lines LEFT JOIN removed ON lines.doc_id = removed.doc_id""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
