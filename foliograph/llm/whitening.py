"""Embedding whitening: leading components of the covariance by FEAST.

Sums and centred products of the distinct vectors are added up by Spark. Eigenvalues are then counted above trial shifts by
the inertia of the shifted covariance, which yields an interval that holds the wanted ones and no others. A contour around it is
integrated by quadrature: at each point of the contour a complex shifted system is solved for a block of vectors, all points
as rows of one job, and the weighted sum projects the block onto the eigenvectors of the interval. Rayleigh-Ritz within
the block extracts them, and their number must be the one that inertia told.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliograph.session import settle

SCALE = 256
COMPONENTS = 4
MAX_DIMENSIONS = 4096  # the covariance, dimensions squared, is on the driver and in each task
POINTS = 16  # of the upper half of the contour
SHIFTS = 32  # counted at once
ROUNDS = 20
_LONG = (1 << 63) - 1

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): entries times 256, rounded down. Rows of a NULL or empty vector, or one with NULL or non-finite entries, are dropped."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    return good.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE).cast("bigint")).alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def moments(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension). High and low halves are added apart, so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _matrix(batch, width)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    parts = fit.mapInArrow(run, "i long, n long, high long, low long")
    sums = parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    rows = sorted(sums.collect(), key=lambda r: r["i"])
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


class Centre(NamedTuple):
    """The mean as a whole number and a remainder below one, which are taken off one after the other."""

    whole: np.ndarray
    rest: np.ndarray

    def take_off(self, x: np.ndarray) -> np.ndarray:
        near = np.abs(x.astype(np.float64)).max(initial=0) + np.abs(self.whole.astype(np.float64)).max(initial=0) < 2.0**62
        away = (x - self.whole).astype(np.float64) if near else x.astype(np.float64) - self.whole.astype(np.float64)
        return away - self.rest


def centre(n: int, sums: list[int]) -> Centre:
    return Centre(np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums], np.float64))


def covariance(fit: DataFrame, n: int, mean: Centre) -> np.ndarray:
    """Centred products over all vectors, divided by their number."""
    width = len(mean.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            y = mean.take_off(_matrix(batch, width))
            total += y.T @ y
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = fit.mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v")))["v"].alias("row")).collect()
    v = np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])]) / n
    return (v + v.T) / 2


# --- eigenvalues of an interval ---------------------------------------------------------


def count_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: the positive pivots of the shifted matrix, with pivots of one or two rows."""
    m, positive = v - shift * np.eye(len(v)), 0
    while len(m):
        diagonal = np.abs(np.diag(m))
        p = int(diagonal.argmax())
        off = np.abs(m - np.diag(np.diag(m)))
        r, s = divmod(int(off.argmax()), len(m))
        if diagonal[p] >= 0.6403882032022076 * off[r, s]:
            if diagonal[p] == 0:
                break  # nothing but zeros is left
            pivots = [p]
            positive += int(m[p, p] > 0)
        else:
            pivots = [r, s]
            positive += 1  # such a pair has one eigenvalue of each sign
        others = np.delete(np.arange(len(m)), pivots)
        border = m[np.ix_(others, pivots)]
        m = m[np.ix_(others, others)] - border @ np.linalg.solve(m[np.ix_(pivots, pivots)], border.T)
        m = (m + m.T) / 2
    return positive


def per_number(spark: SparkSession, numbers: np.ndarray, fn: Callable[[complex], np.ndarray]) -> list[np.ndarray]:
    """``fn`` of each complex number, every one as a row of a Spark job of its own task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, re, im in zip(*[batch.column(c).to_pylist() for c in ("i", "re", "im")]):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([fn(complex(re, im)).ravel()], pa.list_(pa.float64()))], names=["i", "out"])

    rows = spark.createDataFrame([(i, float(z.real), float(z.imag)) for i, z in enumerate(numbers)], "i long, re double, im double")
    found = rows.repartition(min(len(numbers), spark.sparkContext.defaultParallelism), "i").mapInArrow(run, "i long, out array<double>").collect()
    return [np.array(r["out"]) for r in sorted(found, key=lambda r: r["i"])]


def interval(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, count): no eigenvalue is above ``high``, and ``count`` of them, ``wanted`` or a few more where they tie, are above ``low``."""
    shared = spark.sparkContext.broadcast(v)
    top = float(np.abs(v).sum(1).max()) * (1 + 1e-9)
    low, high = 1e-13 * top * len(v), top
    count = count_above(v, low)
    wanted = min(wanted, count)
    if not count:
        return low, top, 0
    upper = high
    while count > wanted and upper - low > 1e-12 * top:
        shifts = np.linspace(low, upper, SHIFTS + 2)[1:-1]
        counts = [int(c[0]) for c in per_number(spark, shifts, lambda z: np.array([float(count_above(shared.value, z.real))]))]
        exact = [s for s, c in zip(shifts, counts) if c == wanted]
        enough = [(s, c) for s, c in zip(shifts, counts) if c >= wanted]
        upper = min([s for s, c in zip(shifts, counts) if c < wanted], default=upper)
        high = min([s for s, c in zip(shifts, counts) if c == 0], default=high)
        low, count = (exact[len(exact) // 2], wanted) if exact else max(enough, default=(low, count))
    shared.unpersist()
    return float(low), float(high), count


def feast(spark: SparkSession, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the ``wanted`` largest eigenvalues of ``v``, fewer if its rank is lower."""
    low, high, count = interval(spark, v, wanted)
    if not count:
        return np.zeros(0), np.zeros((0, len(v)))
    middle, radius = (low + high) / 2, (high - low) / 2
    places, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = np.exp(1j * np.pi / 2 * (1 - places))
    norm, rng, size = np.abs(v).sum(1).max(), np.random.default_rng(13), min(len(v), 2 * count + 4)
    block, error = rng.normal(size=(len(v), size)), np.inf
    shared = spark.sparkContext.broadcast(v)
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(block)

        def solve(turn: complex) -> np.ndarray:
            shifted = (middle + radius * turn) * np.eye(len(shared.value)) - shared.value
            return (radius * turn * np.linalg.solve(shifted, sent.value.astype(complex))).real

        parts = per_number(spark, turns, solve)
        projected = sum(w / 2 * p.reshape(block.shape) for w, p in zip(weights, parts))
        basis, _ = np.linalg.qr(projected)
        values, inner = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ inner
        inside = np.flatnonzero(values > low)
        sent.unpersist()
        if len(inside) < count:  # the block has missed one
            extra = rng.normal(size=(len(v), min(len(v) - block.shape[1], count)))
            block, error = np.concatenate([block, extra], 1), np.inf
            continue
        before, error = error, np.abs(v @ block[:, inside] - block[:, inside] * values[inside]).max() / norm
        if error < 1e-15 or (error < 1e-12 and error > before / 2):
            break
    shared.unpersist()
    if len(inside) != count or error > 1e-9:
        raise ArithmeticError(f"{len(inside)} eigenvalues of {count}, residual {error:.1e}")
    order = inside[::-1][:wanted]
    vectors = block[:, order].T
    vectors *= np.sign(vectors[np.arange(len(order)), np.abs(vectors).argmax(1)])[:, None]
    return values[order], vectors


# --- whitening --------------------------------------------------------------------------


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - S)^2 over the dimensions, exactly; NULL beyond a long."""
    most = n * np.abs(x.astype(np.float64)).max(initial=0) + max(map(abs, sums))
    if most**2 * x.shape[1] < _LONG / 2:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(d) if d <= _LONG else None for d in exact]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of ``embeddings`` (vec_id, embedding): a row for each vector and component, as ``RESULT`` says.

    Rows without a whole finite vector are dropped. Vectors of another length than most have cannot be compared and are dropped too; of
    lengths that are equally frequent the smallest counts. Repeated vectors are fitted once and returned as often as they occur, NULL ids are carried.
    Other columns are ignored. A covariance of lower rank has fewer components; equal vectors and an empty table have
    none, so that the result is empty. Dimensions are bounded by ``MAX_DIMENSIONS``.
    """
    spark = embeddings.sparkSession
    nothing = spark.createDataFrame([], RESULT)
    every = integer_vectors(embeddings)
    usual = every.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if usual is None:
        return nothing
    width = usual["width"]
    if width > MAX_DIMENSIONS:
        raise ValueError(f"{width} dimensions, {MAX_DIMENSIONS} at most")
    rows = every.where(F.size("x") == width)
    fit = settle(rows.select("x").distinct())
    n, sums = moments(fit, width)
    mean = centre(n, sums)
    v = covariance(fit, n, mean)
    values, vectors = feast(spark, v, components)
    k = len(values)
    if not k:
        return nothing
    scaled = (vectors / np.sqrt(values)[:, None]).T

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = mean.take_off(_matrix(batch, width)) @ scaled
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    whitened = fit.mapInArrow(project, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = whitened.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    identity_error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, found))
    explained = values / np.trace(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        for batch in batches:
            x = _matrix(batch, width)
            w, m = mean.take_off(x) @ scaled, len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation]
            columns += [pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, RESULT)
