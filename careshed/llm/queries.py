"""The queries of the training-data operators, each over its whole table, and their DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careshed.llm import conversations, decontaminate, lexical, licenses, line_dedup, minhash, set_join
from careshed.llm.decontaminate import overlaps
from careshed.llm.exact_dedup import exact_duplicates
from careshed.llm.html_text import extract
from careshed.llm.language import languages
from careshed.llm.line_dedup import line_counts
from careshed.llm.lm_score import lm_scores
from careshed.llm.minhash import near_duplicates
from careshed.llm.packing import pieces
from careshed.llm.quality import quality
from careshed.llm.set_join import jaccard_components


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(_read(spark, sf_dir, "documents")).withColumn("dropped_lines", F.array_join(F.col("dropped_lines").cast("array<string>"), ","))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(_read(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_read(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damage(_read(spark, sf_dir, "conversations")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g ON d.norm = g.norm
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_quality_classifier, op3_license_scan, op4_minhash_near_dedup, op5_lm_score, op6_packing, op7_html_extraction, op8_decontamination, op9_language_id, op10_exact_dedup, op11_lexical_search, op12_conversation_repair, op13_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.sql(), "op4_minhash_near_dedup": minhash.sql(), "op3_license_scan": licenses.sql(), "op8_decontamination": decontaminate.sql(), "op10_exact_dedup": OP10_SQL, "op11_lexical_search": lexical.sql(), "op12_conversation_repair": conversations.sql(), "op13_ngram_join": set_join.sql()}
