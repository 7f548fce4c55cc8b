import random
import re

from pyspark.sql import functions as F

from foliograph.llm import decontaminate


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_force(rows, items):
    sets = {}
    for i, text in items:
        sets.setdefault(i, set()).update(shingles(text))
    return sorted({
        (d, i, len(s), len(s & shingles(t))) for d, t in rows for i, s in sets.items() if s and len(s & shingles(t)) >= 0.8 * len(s)
    })


def test_against_brute_force(spark, docs):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 60)))) for i in range(40)] + [(90, None), (91, ""), (3, "five words stand right here")]
    rows = []
    for d in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 900))]
        part = items[d % 40][1].split()
        for _ in range(d % 5):  # edits, and gaps in the item
            if part:
                part[rng.randrange(len(part))] = "edited"
        if d % 3:
            half = len(part) // 2
            words[100:100] = part[:half] if d % 7 == 0 else part
            words += part[half:] if d % 7 == 0 else []
        rows.append((d, " ".join(words).upper() if d % 2 else " ".join(words)))
    rows += [(500, None), (501, "")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    found = decontaminate.leaks(docs(*rows), table).collect()
    got = sorted((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in found)
    assert got == brute_force(rows, items)
    assert got


def test_rows_go_once_and_ties_stay(spark, docs):
    items = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "item_id long, text string")
    rows = docs((1, "x a b c d e f y"), (1, "x a b c d e f y"), (None, "a b c d e f"), (2, "clean text of many other words"), (2, "clean text of many other words"))
    assert decontaminate.leaks(rows, items).count() == 2
    assert [r["doc_id"] for r in decontaminate.decontaminate(rows, items).collect()] == [2, 2]
    assert decontaminate.leaks(docs(), items).count() == 0
    assert decontaminate.decontaminate(rows, items.limit(0)).count() == 5
