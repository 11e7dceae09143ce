"""Whitening against numpy, and the solver on its own."""

import numpy as np
import pytest

from verilake.llm import whitening
from verilake.llm.queries import QUERIES


def x_of(vectors):
    return [[int(np.floor(64.0 * c)) + 1_000_000 for c in v] for v in vectors]


def check(rows, x, ids, k):
    """Rows of one width, against the definitions."""
    n, d = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(d)]
    z = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    v = z.T @ z / n
    values = np.linalg.eigvalsh(v)[::-1][:k]
    by = {}
    for r in rows:
        by.setdefault(r["component"], []).append(r)
    assert set(by) == set(range(1, k + 1))
    deviations = sorted((i, sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True))) for i, own in zip(ids, x, strict=True))
    w = np.zeros((n, k))
    for c, own in by.items():
        assert sorted((r["vec_id"], int(r["deviation"])) for r in own) == deviations and {r["n"] for r in own} == {n}
        assert {round(r["explained"] / (values[c - 1] / np.trace(v)), 9) for r in own} == {1.0}
        w[:, c - 1] = [r["whitened"] for r in sorted(own, key=lambda r: r["vec_id"])]
    z = z[np.argsort(ids, kind="stable")]
    assert np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-9 and {r["identity_error"] < 1e-9 for r in rows} == {True}
    # each column is the projection on a unit eigenvector of v, of that eigenvalue
    u = np.linalg.lstsq(z, w * np.sqrt(values), rcond=None)[0]
    u -= (np.eye(d) - np.linalg.pinv(z) @ z) @ u
    assert np.abs(v @ u - u * values).max() < 1e-8 * values[0] and np.abs(np.linalg.norm(u, axis=0) - 1).max() < 1e-7


def test_query(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = QUERIES["op12_householder_whitening"](spark, sf).collect()
    assert len(rows) == 32 * len(e)
    check(rows, x_of([r["embedding"] for r in e]), [r["vec_id"] for r in e], 32)


def table(spark, vectors, ids=None):
    rows = [(i, v, "x") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").selectExpr("*", "1 AS n", "'y' AS width", "2.0 AS whitened").repartition(3)


def test_odd_vectors(spark):
    r = np.random.default_rng(3)
    good = [v.tolist() for v in r.standard_normal((40, 5))]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0]]
    rows = whitening.whitened(table(spark, [*good, *bad])).collect()
    assert len(rows) == 40 * 5
    check(rows, x_of(good), list(range(40)), 5)
    # repeated rows, rows that share an id, and vectors of another width with a model of their own
    both = whitening.whitened(table(spark, [*good, *good, *[v[:2] for v in good]], [*range(40), *range(40), *range(100, 140)]), components=3).collect()
    assert len(both) == 80 * 3 + 40 * 2
    check([r for r in both if r["vec_id"] >= 100], x_of([v[:2] for v in good]), list(range(100, 140)), 2)
    assert {r["n"] for r in both if r["vec_id"] < 100} == {80}
    null_ids = whitening.whitened(table(spark, good, [None] * 40)).collect()
    assert len(null_ids) == 200 and {r["vec_id"] for r in null_ids} == {None}


def test_dimensions_without_variance(spark):
    """Two dimensions repeat others and one is constant: as many components as the vectors differ in."""
    r = np.random.default_rng(4)
    base = r.integers(-200, 200, (50, 3)) / 64.0
    vectors = np.hstack((base, base[:, :2], np.ones((50, 1)))).tolist()
    check(whitening.whitened(table(spark, vectors)).collect(), x_of(vectors), list(range(50)), 3)
    assert whitening.whitened(table(spark, [[1.0, 2.0]] * 5)).count() == 0 and whitening.whitened(table(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.whitened(table(spark, [])).count() == 0 and whitening.whitened(table(spark, [None, [None]])).count() == 0


def test_large_entries(spark):
    """Far from the mean, deviations pass 64 bits and stay exact; entries without bound count as the largest."""
    vectors = [[1e9, 1.0], [-1e9, 2.0], [3.0, 5.0], [7e8, -4.0], [1e300, 0.5]]
    rows = whitening.whitened(table(spark, vectors)).collect()
    x = [[int(np.clip(np.floor(64 * c), -whitening.LARGEST, whitening.LARGEST)) + whitening.OFFSET for c in v] for v in vectors]
    sums = [sum(v[j] for v in x) for j in range(2)]
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == {i: sum((5 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}


@pytest.mark.parametrize("kind", ["random", "identity", "clusters", "zero", "diagonal", "one vector"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigenvectors(kind, n):
    r = np.random.default_rng(n)
    a = r.standard_normal((n, n))
    q = np.linalg.qr(a)[0]
    values = {"random": None, "identity": np.full(n, 3.0), "clusters": np.resize([5.0, 5.0, 5 - 1e-12, 1.0, 1e-9], n), "zero": np.zeros(n), "diagonal": None, "one vector": None}[kind]
    v = a @ a.T if kind == "random" else np.diag(np.arange(n, dtype=float)) if kind == "diagonal" else np.outer(a[0], a[0]) if kind == "one vector" else q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    found, u = whitening.leading_eigenvectors(v, 32)
    size = max(1e-300, np.abs(v).max() * n)
    assert np.abs(found - np.linalg.eigvalsh(v)[::-1][:32]).max() < 1e-13 * size
    assert np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-11 and np.abs(v @ u - u * found).max() < 1e-12 * size


def test_sturm_counts():
    r = np.random.default_rng(1)
    d, e = r.standard_normal(20), r.standard_normal(19)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    shifts = np.sort(np.concatenate((values + 1e-6, values - 1e-6)))
    assert whitening.sturm_count(d, e, shifts).tolist() == [int((values < s).sum()) for s in shifts]
