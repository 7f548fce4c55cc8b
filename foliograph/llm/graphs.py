"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from foliograph.session import per_key, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v); comp is the smallest node reachable.

    Each round hooks every node to the smallest of its neighbourhood, first for the larger neighbours,
    then for the smaller ones, and ends with edges that are stars when nothing changes any more. The edges never
    become more than there were, minima are taken before the shuffle, and each round is a written table,
    so that a lost executor costs a part of one round.
    """
    now = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seal = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = per_key(both, ["u"], F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = per_key(large, ["u"], F.min("v").alias("m"))
        small = large.join(nearest, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        after = small.select("e.u", "e.v").where("u != v").distinct()
        seen = Observation()
        watched = after.observe(
            seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")
        )
        now = settle(watched)
        found = (seen.get["n"], seen.get["x"])
        if found == seal:
            break
        seal = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
