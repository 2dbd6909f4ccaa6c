"""Whitening against dense eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratebook.llm.whitening import components, jacobi_davidson, minres, op11_whitening, prepared, whiten


@pytest.mark.parametrize(("size", "wanted", "spectrum"), [(64, 32, "flat"), (200, 12, "slow"), (300, 8, "fast"), (5, 32, "flat"), (1, 3, "flat"), (120, 10, "twins")])
def test_eigenpairs(size, wanted, spectrum):
    rng = np.random.default_rng(size)
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = {"flat": 1 + rng.random(size), "slow": 1 / np.arange(1, size + 1), "fast": 0.7 ** np.arange(size), "twins": np.repeat(np.arange(size // 2, 0, -1.0), 2)[:size]}[spectrum]
    a, calls = (q * values) @ q.T, []

    def apply(block):
        calls.append(block.shape)
        return a @ block

    got, vectors = jacobi_davidson(apply, size, wanted)
    want = np.sort(values)[::-1][:wanted]
    assert np.abs(got - want).max() < 1e-12 * want[0] and np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12 * want[0]
    assert all(s[1] <= wanted + 8 for s in calls)


def test_minres_lowers_the_residual():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((20, 20))
    a, b = a + a.T, rng.standard_normal((20, 3))
    left = [np.linalg.norm(b - a @ minres(lambda t: a @ t, b, k), axis=0) for k in (0, 2, 6, 20)]
    assert all((x >= y - 1e-9).all() for x, y in zip(left, left[1:], strict=False)) and left[-1].max() < 1e-6
    for k in (1, 3):  # the least over the Krylov space of k directions
        krylov = np.stack([np.linalg.matrix_power(a, i) @ b[:, 0] for i in range(k)], axis=1)
        best = np.linalg.norm(b[:, 0] - a @ krylov @ np.linalg.lstsq(a @ krylov, b[:, 0], rcond=None)[0])
        assert math.isclose(np.linalg.norm(b[:, 0] - a @ minres(lambda t: a @ t, b, k)[:, 0]), best, rel_tol=1e-9)


def by_hand(vectors):
    x = np.floor(64.0 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, [sum(int(v) ** 2 for v in row) for row in (x * n - s).tolist()], c, e[::-1], u[:, ::-1]


def test_whole_table(spark):
    got = op11_whitening(spark, "/root/testdata/sf0.001").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    n, deviation, c, e, u = by_hand(list(table.embedding))
    assert len(got) == 32 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == dict(zip(table.vec_id, deviation, strict=True))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    want = c @ u[:, :32] / np.sqrt(e[:32])
    want *= np.sign((wide * want).sum(axis=0))
    assert np.abs(wide - want).max() < 1e-8
    first = got[got.vec_id == table.vec_id[0]].sort_values("component")
    assert np.abs(first.explained.to_numpy() - e[:32] / e.sum()).max() < 1e-12


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, -3.0]), (1, [1.0, 2.0, -3.0]), (None, [0.5, 0.25, 0.0]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 0.0, 0.0]), (6, [7.0]), (7, []), (8, [-0.001, 0.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("mine")).withColumn("n", F.lit(1))
    data = prepared(table)
    got = whiten(data, components(data)).toPandas()
    kept = [(i, [*v, 0.0, 0.0, 0.0][:3]) for i, v in rows if i not in (2, 3, 4, 5)]
    n, deviation, _, e, _ = by_hand([v for _, v in kept])
    assert len(got) == 3 * n and sorted(got.deviation) == sorted(d for d in deviation for _ in range(3)) and got.vec_id.isna().sum() == 3
    assert np.abs(sorted(set(got.eigenvalue), reverse=True) - e).max() < 1e-9 * e[0]
    for case in ([], [(1, None)], [(1, [2.0, 2.0])], [(1, [2.0]), (2, [2.0])]):
        data = prepared(spark.createDataFrame(case, "vec_id long, embedding array<float>"))
        assert whiten(data, components(data)).collect() == []
