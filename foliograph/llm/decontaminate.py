"""Benchmark decontamination: a containment search by size-partitioned MinHash, then exact shingle containment.

Items are partitioned by size, in powers of two. The items of a partition are filed under a bottom-k MinHash
sketch: their k smallest shingle hashes, where k = floor((1 - threshold) * u) + 1 for the largest size u of the
partition. A document that holds the wanted share of an item misses fewer than k of its shingles, whatever the
length of the document, so it holds at least one hash of the sketch. The search therefore loses no item, and long
documents need no windows. Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliograph.llm.common import row_key, small, words, written

SHINGLE = 5
THRESHOLD = 0.8


def _join_words(parts: Column, at: Column, width: int) -> Column:
    return F.concat_ws(" ", *[F.get(parts, at + i) for i in range(width)])


def shingle_texts(parts: str, width: int = SHINGLE) -> Column:
    """The distinct shingles, as texts, of a column of words (a column, so that words are found once per text)."""
    spots = F.sequence(F.lit(0), F.size(parts) - width)
    texts = F.transform(spots, lambda i: _join_words(F.col(parts), i, width))
    return F.when(F.size(parts) >= width, F.array_distinct(texts)).otherwise(F.array().cast("array<string>"))


def _word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _shingle_hash(width: int) -> Column:
    return F.xxhash64(*[F.get(F.col("_w"), F.col("_i") + i) for i in range(width)])


def shingle_hashes(docs: DataFrame, keep: list[str], width: int = SHINGLE) -> DataFrame:
    """One row per shingle: ``keep`` and its hash ``h``. Word hashes come first, so that a shingle is five numbers."""
    hashed = docs.select(*keep, _word_hashes(F.col("text")).alias("_w"))
    every = F.when(F.size("_w") >= width, F.sequence(F.lit(0), F.size("_w") - width))
    # outer, and a filter on the place: one on the array would find the words a second time
    spots = hashed.select(*keep, "_w", F.explode_outer(every).alias("_i")).where("_i is not null")
    return spots.select(*keep, _shingle_hash(width).alias("h"))


def sketch_index(items: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """(h, item_id): the bottom-k sketch of each item, k by the size partition of the item."""
    arrays = items.withColumn("_w", _word_hashes(F.col("text"))).where(F.size("_w") >= width)
    spots = F.sequence(F.lit(0), F.size("_w") - width)
    hashes = F.array_sort(F.array_distinct(F.transform(spots, lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(width)]))))
    sized = arrays.select("item_id", hashes.alias("hs")).withColumn("n", F.size("hs"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    k = (F.floor(F.lit(1 - threshold + 1e-9) * upper) + 1).cast("int")
    return sized.select("item_id", F.explode(F.slice("hs", F.lit(1), k)).alias("h"))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """(_key, doc_id, item_id, n_shingles, n_found, containment) for each document that holds ``threshold`` of an item's shingles.

    Compared are lower-case words, shingles as sets. ``docs`` have doc_id and text, ``items`` item_id and text; other columns are
    ignored. NULL or short texts (fewer than ``width`` words) hold nothing and are found nowhere. A repeated row of
    ``docs`` gives one row here, a repeated item (same id and text) too; items that share an id but not a text
    count as one with all their shingles. Empty tables give an empty table.

    The scan of the documents meets the sketch index in one stage and moves only hits. The index is broadcast if its counted
    rows are below the bound, else both sides shuffle by hash; candidates likewise.
    """
    items = items.select("item_id", "text").where("text is not null")
    index, n_index = written(sketch_index(items, threshold, width).distinct())
    keyed = docs.select("doc_id", "text").withColumn("_key", row_key())
    hits = shingle_hashes(keyed, ["_key"], width).join(small(index, n_index), "h")
    found, n_found = written(hits.select("_key", "item_id").distinct())
    parts = words(F.lower("text")).alias("_w")
    held = items.select("item_id", parts).select("item_id", F.explode(shingle_texts("_w", width)).alias("s")).groupBy("item_id")
    sets, n_sets = written(held.agg(F.collect_set("s").alias("wanted")))
    pairs = keyed.join(small(found, n_found), "_key").join(small(sets, n_sets), "item_id")
    common = F.size(F.array_intersect(shingle_texts("_w", width), F.col("wanted")))
    counted = pairs.select("_key", "doc_id", "item_id", "wanted", parts).select(
        "_key", "doc_id", "item_id", F.size("wanted").cast("bigint").alias("n_shingles"), common.cast("bigint").alias("n_found")
    )
    # grouping makes repeated rows one, and keeps the filter below from being pushed into the shingles
    once = counted.groupBy("_key", "doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))
    return once.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= threshold)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold an item of ``items``."""
    found, n = written(leaks(docs, items, **options).select("_key").distinct())
    return docs.withColumn("_key", row_key()).join(small(found, n), "_key", "left_anti").drop("_key")


SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), bw AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw)
), bn AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS n_found FROM sh JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found::DOUBLE / n_shingles AS containment
FROM hit JOIN bn USING (item_id) WHERE n_found >= 0.8 * n_shingles
"""
