"""A training corpus from raw documents: each stage works on what the one before kept.

Quality classifier, exact deduplication, near-deduplication, benchmark decontamination, packing. The middle stages give
rows numbers of their own, so that repeated and missing ids are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careshed.llm.common import table, with_row_ids, without
from careshed.llm.decontaminate import overlaps
from careshed.llm.exact_dedup import exact_duplicates
from careshed.llm.minhash import near_duplicates
from careshed.llm.packing import pieces
from careshed.llm.quality import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; the labels of held-out documents are not learned."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _dropping(docs: DataFrame, dropped) -> DataFrame:
    """``docs`` without the rows that ``dropped`` names, given the rows' own numbers as doc_id."""
    rows, key = with_row_ids(docs)
    return without(rows, dropped(rows.select(F.col(key).alias("doc_id"), "text")), key).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, also of rows that share an id or have none."""
    return _dropping(docs, lambda rows: exact_duplicates(rows).where("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal texts: the least doc_id."""
    return _dropping(docs, lambda rows: near_duplicates(rows).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _dropping(docs, lambda rows: overlaps(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of fixed length."""
    return pieces(docs)


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]

#: A learned model and token ids are beyond SQL; the tests hold the stages after the classifier to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
