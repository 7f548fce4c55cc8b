import numpy as np
from pyspark.sql import functions as F

from foliograph.llm import attention

ROOT = "/root/testdata/sf0.01"


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    x, bounds, label = rng.normal(size=(9, attention.FEATURES)), np.array([0, 4, 5, 9]), np.array([1.0, 0, 1])
    before = attention._forward(attention.fit(x, bounds, label, steps=1), x, bounds)[0]
    after = attention._forward(attention.fit(x, bounds, label, steps=60), x, bounds)[0]

    def loss(s):
        return -(label * np.log(s) + (1 - label) * np.log(1 - s)).mean()

    assert loss(after) < 0.2 * loss(before)


def test_weights_of_passages_sum_to_one_and_texts_do_not_mix():
    model = attention.fit(np.random.default_rng(1).normal(size=(6, attention.FEATURES)), np.array([0, 2, 6]), np.array([0.0, 1.0]), steps=5)
    texts = [b"one two " * 100, None, b"", b"\xc3\xa9 " * 7, b"x" * 2_500_000]
    x, bounds = attention.encode(texts)
    assert list(np.diff(bounds)) == [4, 1, 1, 1, 1]
    scores, (owner, *_, weight, _) = attention._forward(model, x, bounds)
    assert np.allclose(np.bincount(owner, weight), 1)
    for i, text in enumerate(texts):
        alone, edges = attention.encode([text])
        assert np.allclose(attention._forward(model, alone, edges)[0], scores[i])


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    scored = attention.score_quality(docs.withColumn("score", F.lit("clash")), labels.select("doc_id", "quality")).join(labels, "doc_id").where("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet").limit(300), spark.read.parquet(f"{ROOT}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(attention.score_quality(docs, t).select("doc_id", "score").collect()) for t in (labels, turned))
    assert one == two


def test_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = attention.score_quality(docs((1, None), (None, ""), (1, "a")), none).collect()
    assert [r["score"] for r in found] == [0.5] * 3
    assert [r["predicted"] for r in found] == [1] * 3
    assert attention.score_quality(docs(), none).count() == 0
