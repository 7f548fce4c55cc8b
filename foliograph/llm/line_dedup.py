"""Line dedup across sites: HyperLogLog sketches of the sites per line, exact counts near the threshold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from foliograph.llm.common import WORD, row_key
from foliograph.session import per_key, settle

LG_K = 10
MIN_SITES = 10


def _lines(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, site, pos, h1, h2) per line that has a word; the two hashes are its identity."""
    each = docs.select("_key", "doc_id", F.col("source").alias("site"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    worded = each.where(F.col("line").rlike(WORD))
    return worded.select("_key", "doc_id", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def repeated_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(_key, doc_id, pos) of the line occurrences to remove, for ``docs`` with _key, doc_id, source and text.

    A line is boilerplate if it stands on ``min_sites`` sites or more. Sketches of the sites merge per line, so a
    line of any frequency is one small row after the first shuffle. Where the estimate is within three standard
    errors of the threshold, the distinct sites are counted; beyond, it decides. The first occurrence
    (smallest doc_id, then position) stays.
    """
    lines = _lines(docs)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    error = 3 * 1.04 / math.sqrt(2**lg_k)
    low, high = math.floor(min_sites * (1 - error)), math.ceil(min_sites * (1 + error))
    sites = spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low)
    frequent = settle(sites)
    hits = settle(lines.join(frequent, ["h1", "h2"]))
    near = hits.where(F.col("sites") <= high).select("h1", "h2", "site").distinct()
    exact = near.groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites)
    sure = frequent.where(F.col("sites") > high).select("h1", "h2")
    first = per_key(hits, ["h1", "h2"], F.min(F.struct("doc_id", "pos")).alias("first"))
    chosen = first.join(sure.unionByName(exact.select("h1", "h2")), ["h1", "h2"], "left_semi")
    doomed = hits.join(per_key(chosen, ["h1", "h2"], F.min("first").alias("first")), ["h1", "h2"])
    return doomed.where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first"))).select("_key", "doc_id", "pos")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs`` (doc_id, text, source and others) without cross-site boilerplate lines, plus n_lines and n_removed.

    Lines are what stands between line breaks, compared as they are; lines without a word are never removed. A NULL
    source is no site. NULL texts stay NULL with no lines; an empty text has one line. Rows that repeat id
    and text are treated alike. An empty table gives an empty table. Columns named like the two new ones are replaced.
    A text keeps its other lines in order; one that loses every line becomes empty but its row stays.
    """
    keyed = docs.drop("n_lines", "n_removed", "_key").withColumn("_key", row_key())
    removed = repeated_lines(keyed, min_sites, lg_k)
    per_doc = per_key(removed, ["_key", "doc_id"], F.collect_set("pos").alias("_gone")).withColumnRenamed("doc_id", "_id")
    per_doc = per_doc.withColumnRenamed("_key", "_k")
    same = (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    joined = keyed.join(per_doc, same, "left")
    lines = F.col("_lines")  # a column: inside a lambda the expression would split the text for every line
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    text = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return (
        joined.withColumn("_lines", F.split("text", "\n"))
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint"))
        .withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint"))
        .withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(text))
        .drop("_key", "_k", "_id", "_gone", "_lines")
    )


SQL = """
WITH l AS (
  SELECT doc_id, source, line, pos FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
      unnest(range(0, len(string_split(text, chr(10))))) AS pos
    FROM documents WHERE text IS NOT NULL)
), boiler AS (
  SELECT line, min({'d': doc_id, 'p': pos}) AS first FROM l
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.*, b.line IS NOT NULL AND {'d': doc_id, 'p': pos} <> b.first AS gone
  FROM l LEFT JOIN boiler b ON l.line = b.line
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text,
    count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
