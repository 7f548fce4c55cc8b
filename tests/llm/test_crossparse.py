import random

import numpy as np
from pyspark.sql import functions as F

from foliograph.llm import crossparse


def plain_phrases(train, text):
    """Greedy longest matches, piece by piece; a byte that never occurs is a phrase of its own."""
    total = 0
    for at in range(0, len(text), crossparse.PIECE):
        piece = text[at : at + crossparse.PIECE]
        i = 0
        while i < len(piece):
            n = 0
            while i + n < len(piece) and piece[i : i + n + 1] in train:
                n += 1
            total += 1
            i += max(1, n)
    return total


def test_phrases_against_substring_search():
    rng = random.Random(8)
    train = {"x": "".join(rng.choice("abc ") for _ in range(400)), "y": "".join(rng.choice("bcd ") for _ in range(300))}
    model = crossparse.build({k: np.frombuffer(v.encode(), np.uint8) for k, v in train.items()})
    texts = ["".join(rng.choice("abcd e") for _ in range(n)) for n in (0, 1, 5, 511, 512, 513, 1500)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = crossparse.phrases(model, data, bounds)
    for row, lang in enumerate(model["langs"]):
        for i, text in enumerate(texts):
            # an unknown byte closes the phrase before it and is carried by the next one
            assert abs(got[row][i] - plain_phrases(train[lang], text)) <= text.count("e") + text.count("a") * (lang == "y") + text.count("d") * (lang == "x")
    known = "".join(rng.choice("bc ") for _ in range(2000))
    exact = crossparse.phrases(model, np.frombuffer(known.encode(), np.uint8), np.array([0, 2000]))
    assert [int(v) for v in exact[:, 0]] == [plain_phrases(train[lang], known) for lang in model["langs"]]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = crossparse.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_edges(docs):
    rows = [(i, "the cat and the dog " * 3, "s", "en") for i in range(20)] + [(50 + i, "der hund und die katze " * 3, "s", "de") for i in range(20)]
    rows += [(90, None, "s", "en"), (91, "12 34 !?", "s", None), (None, "die katze", None, None), (92, "", None, None), (92, "the dog", None, None), (93, "ΑΒΓ", None, None)]
    found = crossparse.predict_language(docs(*rows)).collect()
    by_id = {(r["doc_id"], r["lang_pred"]) for r in found if r["doc_id"] is None or r["doc_id"] >= 90}
    assert {(90, "und"), (91, "und"), (None, "de"), (92, "und"), (92, "en")} <= by_id
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == len(rows)
    assert crossparse.predict_language(docs()).count() == 0
    assert [r["lang_pred"] for r in crossparse.predict_language(docs((1, "words", None, None))).collect()] == ["und"]


def test_other_labels_leave_an_automaton_as_it_is(docs):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(rng.choice(list("abcde" if i % 2 else "defgh"), 6)) for _ in range(300)), None, "xa" if i % 2 else "yb") for i in range(40)]
    rare = [(100 + i, f"odd label {i}", None, f"zz{i}") for i in range(40)]
    few, many = crossparse.train(docs(*rows), each=2000, together=4000), crossparse.train(docs(*rows, *rare), each=2000, together=4000)
    bits = [{lang: b for m in models for lang, b in zip(m["langs"], m["bits"])} for models in (few, many)]
    assert len(few) == 1 and len(many) > 1 and bits[0].items() <= bits[1].items()
    one, several = ({r["doc_id"]: r for r in crossparse.predict_language(docs(*rows, *rare), each=2000, together=t).collect()} for t in (10**6, 2000))
    assert one == several
