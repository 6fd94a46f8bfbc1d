"""The corpus pipeline: rules, classifier, near-duplicates, packing, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakesignal.llm import near_dup, packing, quality_cnn, quality_rules
from lakesignal.llm.common import settle, table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base thresholds and the learned rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network keeps; it learns from all documents, also those the rules reject."""
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8)."""
    return near_dup.keep_one(docs, width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces stand in the training sequences."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", near_dup_stage),
    ("packing", packing_stage),
]

#: The learned stages can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"pipeline-{name}")
    return docs
