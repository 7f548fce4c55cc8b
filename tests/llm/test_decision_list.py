import random
import re

import numpy as np
from pyspark.sql import functions as F

from foliograph.llm import decision_list as dl

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_against_plain_python(docs):
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, "\n \n"), (3, "a b c d e f g h " * 3), (4, "übér ###\tx\u00a0y\r\n|<>&\x0b\x0cz 12 !!"), (5, "same\nsame\n same\nsame\n\nsame"), (6, "x" * 3_000_000 + " y")]
    for i in range(200):
        line = [" ".join(rng.choice("abcé") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(9))]
        rows.append((10 + i, "\n".join(line) + rng.choice(["", "\n", " "])))
    rows.append((999, " ".join(f"w{rng.randrange(3000)}" for _ in range(300_000))))
    got = {r["doc_id"]: tuple(r[c] for c in dl.COUNTS[:5]) for r in dl.with_counts(docs(*rows), ["doc_id"]).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_a_known_list_is_found_again(spark):
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] <= 0.5)) | (x[:, 2] > 0.95)
    rules = dl.learn_rules(x, bad)
    table = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    kept = np.array([r["k"] for r in table.select(dl.as_column(rules, ["a", "b", "c"]).alias("k")).collect()])
    assert (kept != bad).mean() > 0.99
    assert all(text.endswith("reject") for text in dl.as_text(rules, ["a", "b", "c"]))


def test_base_and_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 0)], "doc_id long, quality int")
    text = " ".join(f"word{i}" for i in range(30))
    found = dl.judge_quality(docs((1, text), (1, text), (2, "few words"), (None, None), (3, "a b c d e f g h " * 9)), labels).collect()
    assert sorted((str(r["doc_id"]), r["base_failed"], r["kept"]) for r in found) == [
        ("1", False, True), ("1", False, True), ("2", True, False), ("3", True, False), ("None", True, False),
    ]
    assert dl.judge_quality(docs(), labels).count() == 0


def test_held_out_labels(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    judged = dl.judge_quality(docs, labels.where(F.col("doc_id") % 2 == 0)).join(labels.where(F.col("doc_id") % 2 == 1), "doc_id")
    told = judged.where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in told.collect()}
    assert kept[1] > 0.97 and kept[0] < 0.3
