"""The corpus pipeline: grade, dedup lines, keep one of each near-duplicate class, decontaminate, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugework.llm import decontaminate, grading, jaccard_join, line_dedup, mixing
from gaugework.llm.store import settle, table
from gaugework.plans.registry import ship

#: Its classifiers, near-duplicate classes and rates are beyond SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the top grade."""
    ship(spark)
    return grading.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more of them share."""
    return line_dedup.drop_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents."""
    ship(spark)
    return jaccard_join.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of positive rate, with their text, domain, rate and copies."""
    ship(spark)
    return mixing.keep_rated(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = settle(docs) if i < len(STAGES) - 1 else docs
    return docs
