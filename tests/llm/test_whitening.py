"""Whitening against a plain eigendecomposition in numpy."""

import math
import os

import numpy as np
import pytest

from foliograph.llm import queries, whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, extra string"


def plain(rows, k=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of (vec_id, entries)."""
    xs = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows]
    fit = np.array(sorted({x for _, x in xs}), object)
    n, s = len(fit), fit.sum(0)
    y = np.array([[float(n * a - b) / n for a, b in zip(x, s)] for x in fit])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    out = {}
    for i, x in xs:
        d = np.array([n * a - b for a, b in zip(x, s)], object)
        for c in range(1, min(k, len(values)) + 1):
            e, u = values[-c], vectors[:, -c]
            if e > 1e-9 * values[-1]:
                out[i, c] = (n, int((d**2).sum()), abs(float((d / n).astype(float) @ u)) / math.sqrt(e), e / np.trace(v))
    return out


def same(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(whitened, rel=1e-6, abs=1e-8)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    same(queries.QUERIES["op13_whitening"](spark, SF).collect(), plain([tuple(r) for r in rows]))


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * [3, 2, 1, 1, 0.5, 0.1]]) for i in range(80)]
    copies = [(1000 + i, good[0][1]) for i in range(300)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [math.nan] * 6), (2004, [math.inf] + [0.0] * 5), (2005, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + copies + odd], KIND).repartition(3)
    same(whitening.whiten(df).collect(), plain(good + copies))


def test_low_rank_and_ties(spark):
    cross = [(0, [1.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, -1.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, "") for i, v in cross], KIND)).collect()
    assert {r.component for r in got} == {1, 2} and all(r.explained == pytest.approx(0.5) and r.identity_error < 1e-9 for r in got)
    many = [(i, [float(c) for c in np.eye(7)[i % 7] * (1 if i < 7 else -1)]) for i in range(14)]
    got = whitening.whiten(spark.createDataFrame([(i, v, "") for i, v in many], KIND)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and all(r.explained == pytest.approx(1 / 7) and r.identity_error < 1e-9 for r in got)


def test_nothing_to_fit(spark):
    assert whitening.whiten(spark.createDataFrame([], KIND)).isEmpty()
    same_vector = [(i, [1.0, 2.0], "") for i in range(5)]
    assert whitening.whiten(spark.createDataFrame(same_vector, KIND)).isEmpty()
    assert whitening.whiten(spark.createDataFrame([(None, [1.0], ""), (1, [2.0], "")], KIND)).count() == 2


def test_large_entries(spark):
    rows = [(i, [1e15 + i * 1e9, float(i % 3)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain(rows)
    got = whitening.whiten(df).collect()
    assert all(r.deviation == (d if (d := want[r.vec_id, r.component][1]) < 2**63 else None) for r in got) and any(r.deviation is None for r in got)


def test_count_above():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 30):
        a = rng.normal(size=(size, size))
        a, values = a + a.T, np.linalg.eigvalsh(a + a.T)
        for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1, 0.0]:
            assert whitening.count_above(a, shift) == (values > shift).sum()
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.count_above(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("size", [5, 40])
def test_feast_finds_all(spark, size):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    values = np.sort(rng.uniform(0.5, 1, size))[::-1]
    values[2:4] = values[2]
    v = (q * values) @ q.T
    found, vectors = whitening.feast(spark, (v + v.T) / 2)
    assert found == pytest.approx(values[:4], rel=1e-12)
    assert np.abs(vectors @ v - found[:, None] * vectors).max() < 1e-13
