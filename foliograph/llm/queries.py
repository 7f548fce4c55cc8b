"""Queries of the operators, over whole tables with production parameters, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliograph.llm import attention, crossparse, decision_list, decontaminate, line_dedup, mixing, ppm, prefix_trie, secret_forest, simhash, toxicity, url_rules, whitening
from foliograph.llm.common import table
from foliograph.session import prepare, settle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # whole texts travel in them
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register


@query("op1_line_dedup", line_dedup.SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


@query("op6_decontaminate", decontaminate.SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).drop("_key")


@query("op7_mixing", mixing.SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix_counts(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op3_quality_attention")
def op3_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = attention.score_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decision_list.judge_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


@query("op5_language_crossparse")
def op5_language_crossparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse.predict_language(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("op8_ppm")
def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op10_url_rules")
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's URL ends in the id of its document, whose quality is the label of the URL."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where("quality is not null")
    marks = labels.groupBy("doc_id").agg(F.when(F.min("quality") == 0, "block").otherwise("allow").alias("verdict"))
    number = F.regexp_extract(url_rules.path_of(F.col("url")), r"/(\d{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    numbered = pages.select("url", number.try_cast("bigint").alias("doc_id"))
    return url_rules.judge_urls(pages, numbered.join(marks, "doc_id").select("url", "verdict"))


@query("op4_secret_forest")
def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op12_prefix_trie", prefix_trie.SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return prefix_trie.trie(*prefix_trie.share_heads(settle(turns)))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")
