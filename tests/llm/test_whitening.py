"""Whitening against a dense eigendecomposition in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursewright.llm import whitening


def dense(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    c = y.astype(float) / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    return n, (y * y).sum(axis=1), c, e[::-1], w[:, ::-1], np.trace(v)


def compare(spark, vectors, components=8, parts=5):
    d = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(parts)
    got = whitening.whiten(d, components=components).collect()
    n, deviation, c, e, w, trace = dense(vectors)
    assert len(got) == n * components and {(r["id"], r["component"]) for r in got} == {(k, j) for k in range(n) for j in range(1, components + 1)}
    z = np.zeros((n, components))
    for r in got:
        z[r["id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and int(r["deviation"]) == deviation[r["id"]] and abs(r["identity_error"]) < 1e-6
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=1e-9)
    for j in range(components):
        want = c @ w[:, j] / math.sqrt(e[j])
        assert min(np.abs(z[:, j] - want).max(), np.abs(z[:, j] + want).max()) < 1e-6


def test_flat_spectrum(spark):
    compare(spark, np.random.default_rng(1).normal(0, 0.1, (300, 64)))


def test_many_dimensions_with_few_rows_and_steep_values(spark):
    rng = np.random.default_rng(2)
    compare(spark, rng.normal(0, 1, (150, 40)) * np.logspace(1, -1.5, 40))


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.0])
def test_iteration_in_many_dimensions(spark, spread):
    """The filter needs several rounds where the basis cannot hold all dimensions."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 220)) * np.exp(-spread * np.arange(220) / 4)
    d = spark.createDataFrame([([float(c) for c in v],) for v in x], "embedding array<double>").repartition(4)
    p = whitening.Passes.over(d)
    found = whitening.principal_components(p)
    y = np.floor(1024 * x)
    e, w = np.linalg.eigh(np.cov(y.T, bias=True))
    assert found.residual < 1e-11 and (spread == 1.0 or found.rounds > 1)
    assert np.allclose(found.values, e[::-1][:8], rtol=1e-10) and found.trace == pytest.approx(e.sum())
    assert np.allclose(np.abs(np.einsum("ij,ij->j", found.vectors, w[:, ::-1][:, :8])), 1, atol=1e-9)


def test_edges(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k / 7, (k * k) % 5 / 3, 0.5]) for k in range(20)]
    rows = [*good, good[3], (None, [0.25, 0.5, 1.0]), (30, None), (31, [1.0, None, 2.0]), (32, [nan, 1.0, 1.0]), (33, [1.0, -inf, 1.0]), (34, [nan] * 9), (35, [0.5]), (36, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "v", "n", "component", "deviation")})
    monkeypatch.setattr(whitening, "table", lambda *a: d)
    got = whitening.op13_whitening(spark, "").collect()
    left = [r for r in rows if r[0] is None or r[0] < 30] + [(35, [0.5, 0, 0]), (36, [0, 0, 0])]
    _, deviation, c, e, w, _ = dense([v for _, v in left])
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), j) for i, _ in left for j in (1, 2, 3))
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation) and all(r["deviation_exact"] == r["deviation"] for r in got)
    first = sorted(abs(r["whitened"]) for r in got if r["component"] == 1)
    assert np.allclose(first, sorted(np.abs(c @ w[:, 0] / math.sqrt(e[0]))), atol=1e-9)
    for some in (d.limit(0), d.where("vec_id = 30"), d.where("vec_id = 5"), d.where("vec_id = 3")):
        monkeypatch.setattr(whitening, "table", lambda *a, s=some: s)
        assert whitening.op13_whitening(spark, "").collect() == []
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    monkeypatch.setattr(whitening, "table", lambda *a: huge)
    big = whitening.op13_whitening(spark, "").collect()
    assert [r["deviation"] for r in big] == [None, None] and {int(r["deviation_exact"]) for r in big} == {2**90} and all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in big)


def test_deviations_of_any_size():
    rng = np.random.default_rng(5)
    x = rng.integers(90_000, 110_000, (50, 30))
    for n in (50, 10**6, 10**9, 10**12):
        s = rng.integers(90_000, 110_000, 30) * n + rng.integers(0, n, 30)
        assert whitening._deviations(x, s, n) == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
