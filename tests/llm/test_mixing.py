import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliograph.llm import mixing


def targets_by_rounds(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = {}, set(sizes), budget * sum(sizes.values())
    while free:
        share = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rest / share > most * sizes[s]}
        if not over:
            target |= {s: weight[s] * rest / share for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        rest -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_against_rounds(docs):
    rows = [(i, "w " * (i % 13) + " x", f"s{i % 7}" if i % 11 else None) for i in range(300)]
    rows += [(3, None, "s3"), (None, "a b", "s1"), (5, "", "s5"), (5, "", "s5")]
    found = mixing.mix_counts(docs(*rows)).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words_of(text)
    want = targets_by_rounds(dict(sizes))
    for r in found:
        assert r["size"] == words_of(r["text"])
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        rate = want[r["source"]] / sizes[r["source"]]
        digest = hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()
        coin = int(digest[:13], 16) / 2**52
        assert r["taken"] == r["size"] * (math.floor(rate) + (coin < rate - math.floor(rate)))


def test_one_hot_source_and_stops(docs):
    rows = [(i, "a b c", "big") for i in range(200)] + [(1000 + i, "a b c", "small") for i in range(3)]
    got = {r["source"]: r["target"] for r in mixing.mix_counts(docs(*rows)).select("source", "target").distinct().collect()}
    assert got == targets_by_rounds({"big": 600, "small": 9})


def test_copies_come_out_whole(docs):
    mixed = mixing.mix(docs(*[(i, "a b", "s") for i in range(50)]).withColumn("size", F.lit("clash")))
    counts = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("c"), F.max("copy").alias("k")).collect()
    assert all(r["n"] == r["c"] == r["k"] + 1 for r in counts)


def test_empty(docs):
    assert mixing.mix_counts(docs()).count() == 0
    assert [r["taken"] for r in mixing.mix_counts(docs((1, None, "s"), (2, "", None))).collect()] == [0, 0]
