"""Whitening against numpy's dense decomposition, and odd rows."""

import math

import numpy as np
import pytest

from orrery.llm import whitening as w
from orrery.llm import common


def dense(vectors, k=w.COMPONENTS):
    """By definition: exact integers, dense covariance, its eigenvectors."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    y = n * x - s
    dev = [int(v) for v in (y * y).sum(1)]
    y = y.astype(float) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    return n, dev, e[::-1][:k], q[:, ::-1][:, :k], y


def compare(got, ids, vectors, k, near=1e-7):
    n, dev, e, q, y = dense(vectors, k)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    trace = (y * y).sum() / n
    for c, rows in by.items():
        assert len(rows) == n and {r.n for r in rows} == {n}
        assert sorted((r.vec_id is not None, r.vec_id, r.deviation) for r in rows) == sorted((i is not None, i, v) for i, v in zip(ids, dev, strict=True))
        assert {round(r.explained, 9) for r in rows} == {round(e[c - 1] / trace, 9)}
        assert all(r.identity_error < 1e-9 for r in rows)
        want = dict(zip(ids, y @ q[:, c - 1] / math.sqrt(e[c - 1]), strict=True))
        z = np.array([r.whitened for r in rows])
        v = np.array([want[r.vec_id] for r in rows])
        assert min(np.abs(z - v).max(), np.abs(z + v).max()) < near


def test_the_whole_table(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    src = common.table(spark, folder, "embeddings").collect()
    passes = []
    got = w.whitened(common.table(spark, folder, "embeddings"), tell=lambda *x: passes.append(x)).collect()
    compare(got, [r.vec_id for r in src], [r.embedding for r in src], 32)
    assert passes[0][1] == 40 and len(passes) < 15 and passes[-1][2] <= 1e-11 * 4096


@pytest.mark.parametrize("d,k,rank", [(5, 3, 5), (300, 32, 300), (300, 4, 300), (120, 32, 120), (2, 32, 2)])
def test_subspace_against_a_dense_matrix(d, k, rank):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, rank)) * 1.01 ** -np.arange(rank)
    v, calls = a @ a.T, []
    e, q = w.subspace(lambda b: v @ b, d, k, lambda *x: calls.append(x))
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-10)
    assert np.abs(v @ q - q * e).max() < 1e-11 * e[0] and np.abs(q.T @ q - np.eye(len(e))).max() < 1e-12


def test_a_steep_spectrum_needs_no_larger_block():
    d = 400
    q0 = np.linalg.qr(np.random.default_rng(0).standard_normal((d, d)))[0]
    v, calls = (q0 * 0.5 ** np.arange(d)) @ q0.T, []
    e, _ = w.subspace(lambda b: v @ b, d, 8, lambda *x: calls.append(x))
    assert np.allclose(e, 0.5 ** np.arange(8), rtol=1e-9) and calls[-1][1] < d


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(np.float32(c)) for c in rng.standard_normal(4)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(good)] + [(7, good[7]), (None, good[8])]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "vec_id long, embedding array<float>, component int, x long").repartition(3)
    compare(w.whitened(df).collect(), [i for i, _ in rows], [v for _, v in rows], 4)


def test_no_variance_and_no_rows(spark):
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert w.whitened(flat).collect() == []
    one = spark.createDataFrame([(i, [1.0 * i, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r.component for r in w.whitened(one).collect()} == {1}
    assert w.whitened(flat.limit(0)).collect() == []


def test_large_entries_stay_exact():
    fit = w.Fit(3, [3 * 2**50, 1])
    x = np.array([[2**50 + 1, 0]], np.int64)
    assert fit.deviation(x) == [9 + 1]
    far = w.Fit(2**40, [0, 0])
    assert far.deviation(np.array([[2**50, 1]], np.int64)) == [2**63 - 1]
    assert far.shifted(np.array([[2**50, 1]], np.int64))[0, 0] == 2**90
