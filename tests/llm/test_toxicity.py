"""Toxicity scores: n-grams against a plain search, held-out labels, odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import toxicity


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def corpus(n=600, share=4):
    rng = random.Random(3)
    clean = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randrange(2, 8))) for _ in range(150)]
    foul = ["grumblax", "wextor", "zizzle"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 120))]
        toxic = i % share == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(foul)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")


def plain_grams(text):
    letters = [" " if c in "\t\n\x0b\x0c\r" else c for c in f" {(text or '').lower()} "]
    return {"".join(letters[i : i + n]) for n in toxicity.ORDERS for i in range(len(letters) - n + 1)}


def test_grams_against_a_plain_search(monkeypatch):
    rng = random.Random(4)
    texts = ["", None, "a", "Ab\tc", "ü" * 7, "x y" * 40, "".join(rng.choice("ab cÄ\n") for _ in range(500)), "q"]
    numbers = {}
    for piece in (1 << 17, 64):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        found = [set() for _ in texts]
        for owner, gram in toxicity.grams(texts):
            assert len(set(zip(owner, gram))) == len(gram)
            for i, g in zip(owner, gram):
                found[i].add(int(g))
        numbers[piece] = found
        assert [len(f) for f in found] == [len(plain_grams(t)) for t in texts]  # no two of these hash alike
    assert numbers[64] == numbers[1 << 17]


def test_ratios_against_counting(spark):
    rows, marks = corpus(200)
    label = dict(marks)
    sample = spark.createDataFrame([(t, label[i]) for i, t in rows], "text string, label int").repartition(3)
    got = sorted(r["ratio"] for r in toxicity.log_count_ratios(sample).collect())
    counts = {}
    for i, t in rows:
        for g in plain_grams(t):
            counts.setdefault(g, [0, 0])[label[i]] += 1
    n = [sum(1 for v in label.values() if v == k) for k in (0, 1)]
    share, want = n[1] / sum(n), []
    for no, yes in counts.values():
        both = no + yes
        if both >= toxicity.LEAST and (yes - both * share) ** 2 / (both * share * (1 - share)) >= toxicity.TELLING:
            want.append(np.log((yes + 1) / (n[1] + 2)) - np.log((no + 1) / (n[0] + 2)))
    assert len(want) > 20 and np.isclose(got, sorted(want)).mean() > 0.9  # a hash may be that of two n-grams


def test_held_out_labels(docs, labels):
    rows, marks = corpus()
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(*rows), labels(marks)).collect()}
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in scored.items())
    told = [(scored[i]["predicted"], t) for i, t in marks if held(i)]
    assert sum(p == t for p, t in told) >= 0.97 * len(told)


def test_only_the_text_counts(docs, labels):
    """Labels of held-out documents, their ids and other columns change no score."""
    rows, marks = corpus(300)
    turned = [(i, 1 - t if held(i) else t) for i, t in marks]
    one = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs(*rows), labels(marks)).collect()}
    other = docs(*rows).withColumns({"score": F.lit("clash"), "label": F.lit(1), "toxic": F.lit(0)})
    two = toxicity.score_toxicity(other, labels(turned).withColumn("text", F.lit("clash")))
    assert two.columns == ["doc_id", "text", "source", "lang", "label", "toxic", "score", "held_out", "predicted"]
    assert {r["doc_id"]: r["score"] for r in two.collect()} == pytest.approx(one)


def test_odd_rows(docs, labels):
    rows, marks = corpus(300)
    long = " ".join(t for _, t in rows[1:4]) * 60
    odd = [(1000, None), (1001, ""), (1002, long), (1003, long + " grumblax"), (None, "x"), (7, rows[7][1])]
    marks += [(1000, None), (None, 1), (8, 1), (8, 0)]
    scored = toxicity.score_toxicity(docs(*rows, *odd), labels(marks)).collect()
    assert len(scored) == len(rows) + len(odd)
    score = {r["doc_id"]: r["score"] for r in scored}
    assert score[1000] == score[1001] and score[1003] > score[1002]
    assert len({r["score"] for r in scored if r["doc_id"] == 7}) == 1
    assert all(r["held_out"] for r in scored if r["doc_id"] is None)  # crc32 of the empty text is 0


def test_missing_labels(docs, labels):
    rows, marks = corpus(40)
    table = docs(*rows)
    assert toxicity.score_toxicity(docs(), labels(marks)).count() == 0
    assert {r["predicted"] for r in toxicity.score_toxicity(table, labels([])).collect()} == {0}
    for kind in (0, 1):
        assert {r["predicted"] for r in toxicity.score_toxicity(table, labels([(i, kind) for i, _ in marks])).collect()} == {kind}
    alike = [(i, "the same text") for i in range(40)]
    assert len({r["score"] for r in toxicity.score_toxicity(docs(*alike), labels(marks)).collect()}) == 1


def test_an_id_that_fills_the_table(spark, docs, labels):
    """One id repeated many times is one labelled document."""
    rows, marks = corpus(200)
    many = docs(*rows).unionByName(spark.range(20_000).selectExpr("0L as doc_id", "concat('grumblax ', id) as text", "'' as source", "'' as lang"))
    taught, stands = toxicity.labelled(many, labels(marks), toxicity.SAMPLE)
    assert taught.count() == sum(1 for i, _ in marks if not held(i)) and stands == {0: 1.0, 1: 1.0}
