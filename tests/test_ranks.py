"""Blocked rankings against plain ones, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.operators import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.6 else rng.randint(2, 40), n, rng.random()) for n in range(4000)]
    return rows, spark.createDataFrame(rows, "k int, seq long, v double")


def per_key(rows):
    groups = {}
    for k, seq, v in sorted(rows):
        groups.setdefault(k, []).append((seq, v))
    return groups


@pytest.mark.parametrize("blocks", ["given", "ranged", "some", "none"])
def test_ordinals(skewed, blocks):
    rows, df = skewed
    block = [ranks.seq_block(F.col("seq"), 100)] if blocks == "given" else None
    most = {"given": 0, "ranged": 0, "some": 100, "none": 5000}[blocks]
    got = {r.seq: r.ordinal for r in ranks.ordinals(df, ["k"], ["seq"], block, most=most).collect()}
    assert got == {seq: n + 1 for group in per_key(rows).values() for n, (seq, _) in enumerate(group)}


@pytest.mark.parametrize("blocks", ["given", "ranged"])
def test_running_max(skewed, blocks):
    rows, df = skewed
    block = [ranks.seq_block(F.col("seq"), 64)] if blocks == "given" else None
    got = {r.seq: r.top for r in ranks.running_max(df, ["k"], ["seq"], block, F.col("v"), "top").collect()}
    want = {}
    for group in per_key(rows).values():
        best = 0.0
        for seq, v in group:
            best = max(best, v)
            want[seq] = best
    assert got == want


def test_sum_before(skewed):
    rows, df = skewed
    counted = df.withColumn("n", (F.col("seq") % 7).cast("long"))
    got = {r.seq: r.s for r in ranks.sum_before(counted, ["k"], ["seq"], [ranks.seq_block(F.col("seq"), 50)], "n", "s").collect()}
    want = {}
    for group in per_key(rows).values():
        total = 0
        for seq, _ in group:
            want[seq] = total
            total += seq % 7
    assert got == want


def test_last_rows(skewed):
    rows, df = skewed
    got = {}
    for r in ranks.last_rows(df, ["k"], ["seq"], 9).collect():
        got.setdefault(r.k, {})[r.tail_pos] = r.seq
    want = {k: {n + 1: seq for n, (seq, _) in enumerate(reversed(group[-9:]))} for k, group in per_key(rows).items()}
    assert got == want


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, seq long")
    got = {r.seq: r.ordinal for r in ranks.ordinals(df, ["k"], ["seq"], [ranks.seq_block(F.col("seq"), 1)]).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_top_rows_are_limited_before_the_shuffle(skewed):
    plan = ranks.last_rows(skewed[1], ["k"], ["seq"], 9)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
