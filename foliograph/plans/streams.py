"""Streaming queries: each reads its table as a file stream and drains it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliograph import catalog
from foliograph.operators.timeline import shown_lines
from foliograph.plans import derived as d
from foliograph.plans.registry import query, table
from foliograph.plans.timelines import PROGRESS_SQL, TOKENS_SQL
from foliograph.streaming import monitors


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    # written as a pattern, the path may be a file as well as a folder of files
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


@query(
    "k1_progress_stream",
    f"WITH {PROGRESS_SQL} SELECT job_id, max(percent) AS percent, count(*) AS reports FROM progress GROUP BY job_id",
)
def progress_stream(spark, sf_dir):
    lines = d.log_lines_of(table_stream(spark, sf_dir, "events"))
    stream = monitors.progress_stream(lines, d.durations(spark, sf_dir))
    folder = monitors.drain(stream, "update", "progress", monitors.merge_progress)
    return monitors.latest_progress(spark, folder).withColumn("percent", F.round("percent", 6))


@query("k2_token_stream", f"SELECT request_id, md5(text) AS text_md5, done, tokens FROM ({TOKENS_SQL})")
def token_stream(spark, sf_dir):
    lines = d.token_lines_of(table_stream(spark, sf_dir, "conversations"))
    folder = monitors.drain(monitors.token_stream(lines), "update", "tokens")
    return monitors.latest_tokens(spark, folder).select("request_id", F.md5("text").alias("text_md5"), "done", "tokens")


@query(
    "k3_tail_stream",
    f"""WITH {d.LOG_SQL}, kept AS (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM log_lines WHERE trim(line) <> '')
    SELECT job_id, seq, trim(line) AS line FROM kept WHERE rn <= {catalog.ERROR_TAIL_LINES}""",
)
def tail_stream(spark, sf_dir):
    lines = shown_lines(d.log_lines_of(table_stream(spark, sf_dir, "events")))
    folder = monitors.tail_stream(lines, catalog.ERROR_TAIL_LINES, ["job_id"], ["seq"])
    return monitors.latest_tail(spark, folder, lines.schema)


@query("k4_manifest_stream", "SELECT DISTINCT concat('/in/', l_orderkey, '/', l_linenumber) AS path FROM lineitem")
def manifest_stream(spark, sf_dir):
    files = table_stream(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("/in/"), "l_orderkey", F.lit("/"), "l_linenumber").alias("path")
    )
    folder = monitors.drain(monitors.manifest_stream(files), "append", "manifest", monitors.merge_files, fold=True)
    return monitors.latest_files(spark, folder)
