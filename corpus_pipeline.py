"""The corpus pipeline: quality, boilerplate lines, near duplicates, benchmark leaks, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliograph.llm import attention, decontaminate, line_dedup, mixing, simhash
from foliograph.llm.common import table
from foliograph.session import prepare, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = attention.score_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return scored.where("predicted = 1").select(*COLUMNS)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id."""
    return simhash.keep_one(docs).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: one row per copy."""
    return mixing.mix(docs).select(*COLUMNS, "size", "source_size", "target", "copies", "copy")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", boilerplate),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing", mixture),
]

# The classifier is trained, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
