"""Joins on a key that holds a third of all rows are split by the skew join."""

import pytest
from pyspark.sql import functions as F

from foliograph.operators import assembly, hierarchy, references, timeline

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "16",
}
ROWS = 90_000


@pytest.fixture
def skew_settings(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(column, others=5000):
    """A third of the rows under key 0, the rest spread out."""
    return F.when(column % 3 == 0, F.lit(0)).otherwise(column % others + 1)


def final_plan(df):
    rows = df.collect()
    return len(rows), df._jdf.queryExecution().executedPlan().toString()


def test_rebase(spark, skew_settings):
    events = spark.range(0, ROWS, 1, 8).select(hot(F.col("id")).alias("k"), F.timestamp_seconds("id").alias("ts"), F.uuid().alias("payload"))
    rows, plan = final_plan(timeline.rebase(events, "k"))
    assert rows == ROWS and "SortMergeJoin(skew=true)" in plan


def test_progress(spark, skew_settings):
    lines = spark.range(0, ROWS, 1, 8).select(
        hot(F.col("id")).alias("job_id"), F.col("id").alias("seq"), F.concat(F.lit("out_time_us="), "id").alias("line"))
    known = spark.range(5001).select(F.col("id").alias("job_id"), F.lit(10.0).alias("duration"))
    rows, plan = final_plan(timeline.log_progress(lines, known))
    assert rows == ROWS and "SortMergeJoin(skew=true)" in plan


def test_children_of_one_parent(spark, skew_settings):
    nodes = spark.range(1, ROWS, 1, 8).select(
        F.col("id").alias("node_id"), F.when(F.col("id") > 5001, hot(F.col("id"))).otherwise(0).alias("parent_id"), F.lit(None).cast("string").alias("a"))
    root = spark.createDataFrame([(0, None, "top")], "node_id long, parent_id long, a string")
    filled = hierarchy.inherit_attributes(root.unionByName(nodes), ["a"])
    rows, plan = final_plan(filled.filter("a = 'top'"))
    assert rows == ROWS and "SortMergeJoin(skew=true)" in plan


def test_references_to_one_object(spark, skew_settings):
    pool = spark.range(0, ROWS, 1, 8).select(
        F.lit(1).alias("merge_id"), F.lit(1).cast("long").alias("doc_seq"), F.col("id").alias("obj_id"), (F.col("id") + 1).alias("new_id"),
        F.lit(None).cast("long").alias("parent_id"), F.array(hot(F.col("id")).cast("long")).alias("refs"))
    rows, plan = final_plan(assembly.rewrite_refs(pool, pool, ["merge_id"]))
    assert rows == ROWS and "SortMergeJoin(skew=true)" in plan


def test_texts_naming_one_file(spark, skew_settings):
    texts = spark.range(0, ROWS, 1, 8).select("id", F.concat(F.lit("/in/"), hot(F.col("id"))).alias("text"))
    manifest = spark.range(6000).select(F.concat(F.lit("/in/"), "id").alias("path"))
    rows, plan = final_plan(references.resolve_refs(texts, manifest).filter("path IS NOT NULL"))
    assert rows == ROWS and "SortMergeJoin(skew=true)" in plan


def test_trim(spark, skew_settings):
    events = spark.range(0, ROWS, 1, 8).select(hot(F.col("id")).alias("k"), F.timestamp_seconds("id").alias("ts"), F.uuid().alias("payload"))
    specs = spark.range(5001).select(F.col("id").cast("int").alias("k"), F.lit("").alias("start"), F.lit("").alias("end"))
    rows, plan = final_plan(timeline.trim_series(events, specs, "k"))
    assert rows == ROWS and "SortMergeJoin(skew=true)" in plan


def test_objects_of_one_merge(spark, skew_settings):
    pool = spark.range(0, ROWS, 1, 8).select(
        hot(F.col("id"), 1000).alias("merge_id"), (F.col("id") % 7).alias("doc_seq"), F.col("id").alias("obj_id"))
    rows, plan = final_plan(assembly.renumber_objects(pool, ["merge_id"]))
    assert rows == ROWS and "SortMergeJoin(skew=true)" in plan


def test_tasks_after_a_shuffle_follow_its_size(spark):
    """Four partitions asked for: what one task gets is bounded by bytes, not a quarter of all rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        wide = spark.range(2_000_000, numPartitions=4).selectExpr("unhex(sha2(string(id), 256)) AS h").distinct()
        assert wide.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
