"""Quality classifier: gated attention over the passages of a document, learned from document labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foliograph.llm.common import bucket, chunks, labelled_sample, repeats, run_hashes, scramble, spans, sums

PASSAGE = 64  # words
HIDDEN = 16
SAMPLE = 4_000  # labelled documents a model is trained on, at most
ACCEPT = 0.3
FEATURES = 14

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CLASSES = np.zeros((7, 256), bool)
_CLASSES[0, 65:91] = True  # capitals
_CLASSES[1, 48:58] = True  # digits
_CLASSES[2, list(b"#*$%&|<>")] = True  # symbols
_CLASSES[3, list(b"!?")] = True
_CLASSES[4, list(b".,;:")] = True
_CLASSES[5, 128:] = True  # bytes of other letters
_CLASSES[6, list(b"\"'()[]{}=/\\_~^@+-")] = True


def encode(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(statistics of every passage, bounds of the passages of each text). A text without words has one empty passage."""
    tables, counts = [], []
    for _, data, offsets in chunks(texts):
        starts, ends = spans(data)
        first = np.searchsorted(starts, offsets)
        n_words = np.diff(first)
        n_passages = np.maximum(1, -(-n_words // PASSAGE))
        edges = np.concatenate(([0], np.cumsum(n_passages)))
        owner = np.repeat(np.arange(len(n_words)), n_passages)
        inside = np.arange(edges[-1]) - edges[owner]
        low = first[owner] + inside * PASSAGE
        high = np.minimum(low + PASSAGE, first[owner + 1])
        bounds = np.append(low, first[-1])  # passages lie end to end
        n = np.maximum(1, high - low)
        lengths = ends - starts
        hashes = run_hashes(data, starts, ends)
        passage = np.repeat(np.arange(len(low)), high - low)
        twice, _ = repeats(scramble(hashes + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        adjacent = np.zeros(len(starts), bool)
        adjacent[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        size = np.maximum(1, sums(lengths, bounds))
        columns = [sums(twice, bounds) / n, sums(adjacent, bounds) / n, size / n / 10]
        columns.append(np.sqrt(np.maximum(0, sums(lengths**2, bounds) / n - (size / n) ** 2)) / 10)
        columns.append((high - low) / PASSAGE)
        for kind in _CLASSES:
            per_word = np.add.reduceat(np.append(kind[data], False).astype(np.int64), starts) if len(starts) else np.zeros(0)
            columns.append(sums(per_word, bounds) / size)
        columns.append(sums(lengths == 1, bounds) / n)
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        begin, stop = np.append(starts, 0)[low], np.append(ends, 0)[high - 1]
        columns.append(np.where(high > low, breaks[stop] - breaks[begin], 0) / n)
        tables.append(np.stack(columns, 1))
        counts.append(n_passages)
    if not tables:
        return np.zeros((0, FEATURES)), np.zeros(1, np.int64)
    return np.concatenate(tables), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(model: dict, x: np.ndarray, bounds: np.ndarray):
    """Passages to document scores: representation, gated attention, weighted sum, logistic unit."""
    at, owner = bounds[:-1], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = np.tanh((x - model["mean"]) / model["scale"] @ model["w"] + model["b"])
    t, g = np.tanh(h @ model["v"]), _sigmoid(h @ model["u"])
    e = t * g @ model["a"]
    weight = np.exp(e - np.maximum.reduceat(e, at)[owner])
    weight /= np.add.reduceat(weight, at)[owner]
    z = np.add.reduceat(weight[:, None] * h, at)
    return _sigmoid(z @ model["c"] + model["d"]), (owner, h, t, g, weight, z)


def fit(x: np.ndarray, bounds: np.ndarray, label: np.ndarray, steps: int = 200, rate: float = 0.02) -> dict:
    """Full-batch Adam on the mean log loss with a little weight decay; the seed is fixed, so reruns agree."""
    rng, n = np.random.default_rng(7), max(1, len(label))
    shapes = {"w": (x.shape[1], HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, HIDDEN), "u": (HIDDEN, HIDDEN), "a": (HIDDEN,), "c": (HIDDEN,)}
    model = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()} | {"d": np.zeros(())}
    model |= {"mean": x.mean(0) if len(x) else np.zeros(x.shape[1]), "scale": x.std(0) + 1e-3 if len(x) else np.ones(x.shape[1])}
    if not len(label):
        return model | {"c": np.zeros(HIDDEN)}
    xs, names = (x - model["mean"]) / model["scale"], [*shapes, "d"]
    first, second = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    for step in range(1, steps + 1):
        score, (owner, h, t, g, weight, z) = _forward(model, x, bounds)
        error = (score - label) / n
        dz = error[:, None] * model["c"]
        dh = weight[:, None] * dz[owner]
        dw = (h * dz[owner]).sum(1)
        de = weight * (dw - np.add.reduceat(weight * dw, bounds[:-1])[owner])
        dt, dg = de[:, None] * model["a"] * g * (1 - t**2), de[:, None] * model["a"] * t * g * (1 - g)
        dh += dt @ model["v"].T + dg @ model["u"].T
        dp = dh * (1 - h**2)
        grad = {"w": xs.T @ dp, "b": dp.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ error, "d": error.sum()}
        for k in names:
            slope = grad[k] + 1e-4 * model[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            model[k] = model[k] - rate * move
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from ``labels`` (doc_id, quality) of documents outside the held-out fold.

    At most ``sample`` labelled ids are used, those of the smallest digest. NULL labels and ids whose labels
    differ teach nothing; without any label every score is one half.
    """
    taught = labelled_sample(docs.select("doc_id", F.col("text").cast("binary").alias("_text")), labels, "quality", sample, bucket(5) != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, bounds = encode(batch.column("_text").to_pylist())
            rows = [x[a:b].ravel() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_label"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "x"]
            )

    found = taught.select("doc_id", "_label", "_text").mapInArrow(run, "doc_id long, label int, x array<double>")
    rows = found.toArrow().sort_by([("doc_id", "ascending")])
    passages = [np.array(r.as_py()).reshape(-1, FEATURES) for r in rows.column("x")]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in passages]))).astype(np.int64)
    x = np.concatenate(passages) if passages else np.zeros((0, FEATURES))
    return fit(x, bounds, rows.column("label").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text and others) with held_out, score and predicted, by a model trained on ``labels``.

    Only the text is an input of a score; each text is scored as a whole, by passages of 64 words. NULL and empty texts
    are one empty passage. Rows that repeat an id are scored one by one; a NULL id is never a label and counts
    as the empty text when folds are drawn, so it is held out. Columns of the three names are replaced. An empty table stays empty.
    """
    docs = docs.drop("held_out", "score", "predicted")
    model = train(docs, labels, sample)
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            x, bounds = encode(texts)
            scores = _forward(model, x, bounds)[0] if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(scores)], names=[*names, "score"])

    scored = docs.mapInArrow(run, schema)
    return scored.withColumn("held_out", bucket(5) == 0).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
