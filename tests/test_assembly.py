"""Merging documents and inheriting attributes, against plain loops."""

import random

from pyspark.sql import functions as F

from foliograph.operators import assembly, hierarchy

SCHEMA = ("merge_id int, doc_seq long, obj_id long, parent_id long, page_no long, refs array<long>, "
          "MediaBox string, Rotate string")
TWO = [
    # two documents with the same ids; page 3 inherits from 1 over 2, page 4 has its own
    (1, 0, 1, None, None, [2], "M1", "R1"), (1, 0, 2, 1, None, [3, 4], None, "R2"), (1, 0, 3, 2, 1, [99, 1], None, None),
    (1, 0, 4, 2, 2, None, "own", None), (1, 5, 1, 2, None, [], None, None), (1, 5, 2, 1, 1, [1], None, None),
    (1, 5, 7, None, 2, None, None, None), (2, 0, 1, None, 1, None, None, None),
]


def test_merge(spark):
    merged, pages, summary = assembly.merge_documents(spark.createDataFrame(TWO, SCHEMA), ["merge_id"], ["MediaBox", "Rotate"])
    got = {(r.doc_seq, r.obj_id): r for r in merged.collect()}
    assert {k: r.new_id for k, r in got.items()} == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (0, 4): 4, (5, 1): 5, (5, 2): 6, (5, 7): 7}
    assert got[0, 3].new_refs == [99, 1] and got[0, 2].new_refs == [3, 4] and got[5, 2].new_refs == [5] and got[0, 4].new_refs == []
    assert (got[0, 3].MediaBox, got[0, 3].Rotate) == ("M1", "R2")
    assert (got[0, 4].MediaBox, got[0, 4].Rotate) == ("own", "R2")
    assert (got[0, 2].MediaBox, got[5, 2].MediaBox) == (None, None)  # no page, and a parent cycle
    assert [got[k].new_parent_id for k in [(0, 1), (0, 2), (0, 3), (5, 1), (5, 7)]] == [None, 1, 8, 6, 8]
    assert [tuple(r) for r in pages.orderBy("position").collect()] == [(1, 1, 0, 3), (1, 2, 0, 4), (1, 3, 5, 6), (1, 4, 5, 7)]
    totals = {r.merge_id: r for r in summary.collect()}
    assert (totals[1].documents, totals[1].pages, totals[1].pages_root, totals[1].catalog_id, totals[1].error) == (2, 4, 8, 9, None)
    assert (totals[2].pages, totals[2].error) == (None, "Need at least 2 PDFs to merge")


def test_merged_pool_has_root_and_catalog_and_renumbers_inside_values(spark):
    """Page 3 inherits a value of node 1 that refers to node 2 and to nothing; page 4 has its own."""
    kind = "merge_id int, doc_seq long, obj_id long, parent_id long, page_no long, refs array<long>, Resources array<struct<text:string,ref:bigint>>"
    values = {1: [("<<", None), (None, 2), (None, 77), (">>", None)], 4: [(None, 4)]}
    rows = [(*r[:6], values.get(r[2]) if r[1] == 0 else None) for r in TWO]
    got = assembly.merged_pool(spark.createDataFrame(rows, kind), ["merge_id"], ["Resources"]).collect()
    plain = {(r.doc_seq, r.obj_id): [tuple(t) for t in r.Resources] if r.Resources else r.Resources for r in got if r.kind is None}
    assert plain[0, 1] == plain[0, 3] == [("<<", None), (None, 2), (None, 77), (">>", None)] and plain[0, 4] == [(None, 4)] and plain[0, 2] is None
    made = {r.kind: (r.merge_id, r.new_id, r.new_refs, r["count"], r.new_parent_id) for r in got if r.kind}
    assert made == {"Pages": (1, 8, [3, 4, 6, 7], 4, None), "Catalog": (1, 9, [8], None, None)}
    moved = [(m, d + 3, *r) for m, d, *r in rows if m == 1] + [(1, 0, 1, None, None, None, None)]  # one document with one object in front
    late = assembly.merged_pool(spark.createDataFrame(moved, kind), ["merge_id"], ["Resources"]).collect()
    assert {r.obj_id: [t.ref for t in r.Resources or []] for r in late if r.doc_seq == 3}[3] == [None, 3, 77, None]


def test_renumber_matches_a_loop(spark):
    rng = random.Random(1)
    rows = list({(rng.choice([1, 1, 1, 2]), rng.randint(0, 300), rng.randint(0, 10**6)) for _ in range(3000)})
    df = spark.createDataFrame(rows, "merge_id int, doc_seq long, obj_id long")
    got = {(r.merge_id, r.doc_seq, r.obj_id): r.new_id for r in assembly.renumber_objects(df, ["merge_id"]).collect()}
    for merge in (1, 2):
        ordered = sorted(k for k in got if k[0] == merge)
        assert [got[k] for k in ordered] == list(range(1, len(ordered) + 1))
    halves = [df.filter(F.col("doc_seq") % 2 == r) for r in (0, 1)]
    united = assembly.union_documents(halves, ["merge_id"])
    assert {(r.merge_id, r.doc_seq, r.obj_id): r.new_id for r in united.collect()} == got


def test_inheritance_matches_a_walk(spark):
    rng = random.Random(2)
    nodes = {}
    for n in range(400):
        parent = rng.choice([None] + [rng.randrange(400)] * 15)  # cycles and missing parents included
        nodes[n] = (450 if rng.random() < 0.02 else parent, *(f"{k}{n}" if rng.random() < 0.1 else None for k in "ab"))
    df = spark.createDataFrame([(n, *v) for n, v in nodes.items()], "node_id long, parent_id long, a string, b string")
    got = {r.node_id: (r.a, r.b) for r in hierarchy.inherit_attributes(df, ["a", "b"]).collect()}

    def nearest(n, place):
        seen = set()
        while n in nodes and n not in seen:
            seen.add(n)
            if nodes[n][place]:
                return nodes[n][place]
            n = nodes[n][0]
        return None

    assert got == {n: (nearest(n, 1), nearest(n, 2)) for n in nodes}


def test_long_chain_and_hot_parent(spark):
    chain = spark.range(1, 201).select(F.col("id").alias("node_id"), (F.col("id") - 1).alias("parent_id"), F.lit(None).cast("string").alias("a"))
    leaves = spark.range(1000, 3000).select(F.col("id").alias("node_id"), F.lit(200).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("a"))
    root = spark.createDataFrame([(0, None, "top")], "node_id long, parent_id long, a string")
    got = hierarchy.inherit_attributes(root.unionByName(chain).unionByName(leaves), ["a"])
    assert got.filter("a = 'top'").count() == 2201
