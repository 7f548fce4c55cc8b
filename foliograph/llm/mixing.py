"""Mixing sources to target weights: sizes per source, capped shares, whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliograph.llm.common import WORD, small, written
from foliograph.operators.ranks import ordinals
from foliograph.session import per_key, settle


def size_of(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def coin(doc_id: Column, seed: str = "") -> Column:
    """A number in [0, 1) that depends on id and seed only: 52 bits of a digest, exact as a double."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def source_targets(sources: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with the ``target`` of each.

    Sources in order of their code points, NULL last, take ``weights`` in turn and share ``budget`` times
    all words by weight. A share above ``most`` times its source stops there and the excess goes to the others
    by weight. The shares that are fair in the end are ``weight * level`` for one level, which rises as
    sources reach their stop; every round is one sum over the table of sources, and a round that stops
    no further source is the last.
    """
    placed = sources.withColumn("_all", F.lit(0)).withColumn("_null", F.col("source").isNull().cast("int"))
    ranked = ordinals(placed, ["_all"], ["_null", "source"], name="rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = settle(ranked.withColumn("weight", weight).drop("_all", "_null"))
    stop = F.lit(most) * F.col("source_size")
    total = budget * float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    stopped, taken, share = -1, 0.0, None
    at_stop: Column = F.lit(False)
    while True:
        n, reached, open_weight = ranked.agg(
            F.count(F.when(at_stop, 1)),
            F.coalesce(F.sum(F.when(at_stop, stop)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at_stop, F.col("weight"))), F.lit(0)),
        ).first()
        if n == stopped or not open_weight:
            break
        stopped, taken = n, float(reached)
        share = F.col("weight") * F.lit(total - taken) / F.lit(float(open_weight))
        at_stop = share >= stop
    target = stop if share is None else F.when(at_stop, stop).otherwise(share)
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def mix_counts(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    budget: float = 1.5,
    most: float = 2.0,
    seed: str = "",
) -> DataFrame:
    """``docs`` (doc_id, text, source and others) with size, source_size, target, rate, copies and taken.

    Rate is target over source size; a document gets floor(rate) copies and one more if its coin falls below
    the rest. NULL texts and texts without words have size 0; NULL is a source of its own, the last one.
    A NULL id has one coin for all such rows, and so have rows that repeat an id. A source without words has
    target and rate 0. An empty table gives an empty table. Columns of these names in ``docs`` are replaced.

    Only id, size and source are moved to count; the hot source is summed before the shuffle.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies", "taken")
    sized = docs.withColumn("size", size_of(F.col("text")))
    sources = per_key(sized, ["source"], F.sum("size").alias("source_size"))
    targets, rows = written(source_targets(settle(sources), weights, budget, most))
    targets = targets.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    extra = (coin(F.col("doc_id"), seed) < F.col("rate") - whole).cast("bigint")
    joined = sized.join(small(targets, rows), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    counted = joined.withColumn("rate", rate).withColumn("copies", whole + extra)
    return counted.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of ``mix_counts`` once per copy, with ``copy`` counting from 0."""
    counted = mix_counts(docs.drop("copy"), **options)
    every = F.sequence(F.lit(0), F.col("copies").cast("int") - 1)
    return counted.where("copies > 0").withColumn("copy", F.explode(every))


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END) AS weight
  FROM src
), ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS stop, 1.5::DOUBLE * sum(source_size) OVER () AS total,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS k
  FROM ranked
), levels AS (
  SELECT *, coalesce(sum(stop) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS reached,
    (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open_weight
  FROM ordered
), fair AS (
  SELECT min(k) AS k FROM levels WHERE weight * (total - reached) / open_weight < stop
), targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN f.k IS NULL OR l.k < f.k THEN l.stop ELSE l.weight * (g.total - g.reached) / g.open_weight END AS target
  FROM levels l CROSS JOIN fair f LEFT JOIN levels g ON g.k = f.k
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
