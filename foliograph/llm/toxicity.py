"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foliograph.llm.common import bucket, scramble
from foliograph.session import settle

ORDERS = (3, 4, 5, 6)  # characters
BITS = 22  # n-grams are told apart by a hash of so many bits
SAMPLE = 5_000  # labelled documents of each label a model is trained on, at most
TELLING = 15.0  # chi-square of an n-gram and the label from which on it is a feature
FEATURES = 1 << 13  # features, at most: those that tell most; their number is sent as 16 bits
LEAST = 3  # documents a feature is in
SMOOTH = 1.0
PENALTY = 0.0003
ACCEPT = 0.5
PIECE = 1 << 17  # characters that are hashed at once

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashed(texts: list[str]) -> np.ndarray:
    """Number of the text and hash of the n-gram, in one number, for each n-gram of some texts."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.where((letters >= 9) & (letters <= 13), np.uint32(32), letters)
    sizes = [len(t) for t in texts]
    ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(texts)), sizes)
    left = ends[owner] - np.arange(len(letters))  # characters up to the end of the text
    code, rolling, keys = letters.astype(np.uint64) + np.uint64(1), np.zeros(len(letters), np.uint64), []
    for n in range(1, max(ORDERS) + 1):
        rolling = rolling[: len(letters) - n + 1] * _STEP + code[n - 1 :]
        if n in ORDERS:
            whole = np.flatnonzero(left[: len(rolling)] >= n)
            grams = scramble(rolling[whole] + np.uint64(n)) >> np.uint64(64 - BITS)
            keys.append(owner[whole].astype(np.int64) << BITS | grams.astype(np.int64))
    return np.concatenate(keys)


def grams(texts: list[str | None], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, n-gram numbers) of whole texts, some texts at a time, a pair once. ``wanted`` marks the n-grams that count.

    A text begins and ends with a blank. A long one is hashed in pieces that overlap, and only the numbers found so far are kept of it.
    """

    def pairs(some: list[str]) -> np.ndarray:
        keys = _hashed(some)
        if wanted is not None:
            keys = keys[wanted[keys & (1 << BITS) - 1]]
        return np.unique(keys)

    at = 0
    while at < len(texts):
        text, stop, size = texts[at] or "", at + 1, len(texts[at] or "")
        if size > PIECE:
            lap = max(ORDERS) - 1
            text, found = f" {text.lower()} ", np.zeros(0, np.int64)
            for begin in range(0, len(text), PIECE):
                inner = text[max(0, begin - lap) : begin + PIECE]
                found = np.union1d(found, pairs([inner]))
            yield np.full(len(found), at), found
        else:
            while stop < len(texts) and size + len(texts[stop] or "") <= PIECE:
                size += len(texts[stop] or "")
                stop += 1
            keys = pairs([f" {(t or '').lower()} " for t in texts[at:stop]])
            yield at + (keys >> BITS), keys & (1 << BITS) - 1
        at = stop


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, float]]:
    """((text, label) of labelled documents outside the held-out fold, how many documents each one of a label stands for).

    Of each label the documents of the smallest digest, up to ``sample``. NULL ids and labels and ids whose labels differ are left out;
    of rows that repeat an id one is taken, that of the smallest digest.
    """
    agreed = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").cast("int").alias("top"))
    usable = agreed.where((F.col("label") == F.col("top")) & (bucket(5) != 0)).join(docs.select("doc_id"), "doc_id", "left_semi")
    usable = settle(usable.select("doc_id", "label", F.xxhash64("doc_id").alias("h")))
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect() if r["label"] in (0, 1)}
    kinds = [usable.where(F.col("label") == k).orderBy("h", "doc_id").limit(sample).select("doc_id", "label") for k in (0, 1)]
    rows = docs.join(F.broadcast(kinds[0].unionByName(kinds[1])), "doc_id")
    single = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("r"))
    return settle(single.select("r.text", "r.label")), {k: n / min(n, sample) for k, n in sizes.items()}


def log_count_ratios(sample: DataFrame) -> DataFrame:
    """(gram, ratio) of the n-grams that tell most about the label by their chi-square, ties by number: how much more often, as a
    logarithm, documents of label 1 have it than those of label 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            label = batch.column("label").to_numpy()
            for owner, gram in grams(batch.column("text").to_pylist()):
                for k in (0, 1):
                    some, times = np.unique(gram[label[owner] == k], return_counts=True)
                    counts[k, some] += times.astype(np.int32)
        used = np.flatnonzero(counts.any(0))
        for some in np.array_split(used, max(1, len(used) >> 14)):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some], pa.int64()), pa.array(counts[1, some], pa.int64())], names=["gram", "no", "yes"])

    kinds = sample.agg(*[F.count_if(F.col("label") == k) for k in (0, 1)]).first()
    counted = sample.mapInArrow(run, "gram long, no long, yes long").groupBy("gram").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    no, yes = [F.log((F.col(c) + SMOOTH) / (n + 2 * SMOOTH)) for c, n in zip(("no", "yes"), kinds)]
    both, base = F.col("no") + F.col("yes"), kinds[1] / max(1, sum(kinds))
    told = F.pow(F.col("yes") - both * base, 2) / (both * base * (1 - base))
    telling = counted.where(both >= LEAST).withColumn("told", told).where(F.col("told") >= TELLING)
    return telling.orderBy(F.desc("told"), "gram").limit(FEATURES).select("gram", (yes - no).alias("ratio"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """(weight of each n-gram, intercept): logistic regression on the ratios of the n-grams that a text has.

    Documents weigh as much as those of their label that they stand for. Where one label is missing all texts score as the other one; without labels 0.
    """
    weights = np.zeros(1 << BITS, np.float32)
    rows, stands = labelled(docs, labels, sample)
    if set(stands) != {0, 1}:
        return weights, 40.0 if stands.get(1) else -40.0
    ratios = sorted(log_count_ratios(rows).collect())
    vocabulary, scale = np.array([r["gram"] for r in ratios], np.int64), np.array([r["ratio"] for r in ratios])
    place = np.full(1 << BITS, -1, np.int16)
    place[vocabulary] = np.arange(len(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((place, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, scale = shared.value
        for batch in batches:
            own = [np.zeros(0, np.int16)] * batch.num_rows
            for owner, gram in grams(batch.column("text").to_pylist(), place >= 0):
                texts, first = np.unique(owner, return_index=True)
                for i, found in zip(texts, np.split(place[gram], first[1:])):
                    own[i] = np.sort(found)
            columns = [batch.column("label"), pa.array([o.astype(np.int32) for o in own], pa.list_(pa.int32())), pa.array([scale[o] for o in own], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "at", "ratio"])

    width = len(vocabulary) + 1  # one that no text has, if none tells anything
    sparse = F.udf(lambda at, ratio: Vectors.sparse(width, at, ratio), VectorUDT())
    weight = F.when(F.col("label") == 1, stands[1]).otherwise(stands[0])
    vectors = rows.mapInArrow(run, "label int, at array<int>, ratio array<double>").select("label", weight.alias("w"), sparse("at", "ratio").alias("x"))
    plan = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=penalty, standardization=False, maxIter=60, tol=1e-5)
    model = plan.fit(settle(vectors))
    weights[vocabulary] = model.coefficients.toArray()[: len(vocabulary)] * scale
    return weights, float(model.intercept)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text and others) with held_out, score and predicted, by a model trained on ``labels`` (doc_id, toxic).

    Only the text is an input of a score, and each text counts as a whole. NULL and empty texts have no n-gram but
    are scored by the intercept. Rows that repeat an id are scored one by one; a NULL id counts as the empty text when folds are drawn. Columns of
    the three names are replaced. An empty table stays empty.
    """
    docs = docs.drop("held_out", "score", "predicted")
    weights, intercept = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), sample)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        wanted = weights != 0
        for batch in batches:
            total = np.full(batch.num_rows, intercept)
            for owner, gram in grams(batch.column("text").to_pylist(), wanted):
                total += np.bincount(owner, weights[gram], batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(score)], names=[*names, "score"])

    scored = docs.mapInArrow(run, schema)
    return scored.withColumn("held_out", bucket(5) == 0).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
