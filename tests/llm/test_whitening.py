"""Whitening: the secular equation and spectra against LAPACK's solver, edge vectors, and the query over its table."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def scatter(x):
    x = x - x.mean(0)
    return x.T @ x


def test_secular_equation():
    from jobloom.llm.whitening import secular

    rng = np.random.default_rng(1)
    for _ in range(300):
        m = rng.integers(1, 30)
        d, z, rho = np.sort(rng.standard_normal(m) * 10.0 ** rng.integers(-6, 6, m)), rng.standard_normal(m) * 10.0 ** rng.integers(-5, 1, m), 10.0 ** rng.integers(-3, 4)
        if m > 1 and np.diff(d).min() < 1e-9:
            continue
        z /= np.linalg.norm(z)
        a, scale = np.diag(d) + rho * np.outer(z, z), max(np.abs(d).max(), rho)
        values, vectors = secular(d, z, rho)
        assert np.abs(values - np.linalg.eigvalsh(a)).max() < 1e-12 * scale
        assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-12 and np.abs(a @ vectors - vectors * values).max() < 1e-12 * scale


def test_spectra_of_any_rank():
    from jobloom.llm.whitening import Spectrum

    rng = np.random.default_rng(2)
    for it in range(150):
        d, n = int(rng.integers(1, 12)), int(rng.integers(1, 60))
        x = rng.integers(-3, 4, (n, d))
        x = x @ rng.integers(-1, 2, (d, d)) if it % 3 == 0 else x
        x = np.repeat(x, 3, 0) if it % 5 == 0 else x
        whole, a, b = Spectrum(d), Spectrum(d), Spectrum(d)
        for k, row in enumerate(x.tolist()):
            whole.add(row)
            (a if 2 * k < len(x) else b).add(row)
        a.merge(b)
        want = scatter(x.astype(float))
        for s in (whole, a):
            assert s.n == len(x) and s.sums == x.sum(0).tolist()
            assert np.abs((s.vectors * s.values) @ s.vectors.T - want).max() < 1e-9 * max(1, np.abs(want).max())
            assert np.abs(s.vectors.T @ s.vectors - np.eye(len(s.values))).max(initial=0) < 1e-10


def check(rows, n, error, x_of, k, explained):
    """rows: (x, deviation, whitened) of all rows; the fit list is their distinct x."""
    fit = np.array(sorted(set(map(tuple, x_of))), dtype=float)
    values, vectors = np.linalg.eigh(scatter(fit) / len(fit))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert n == len(fit) and error <= 1e-9
    assert np.allclose(explained, values[:k] / values.sum(), rtol=1e-9)
    sums = [sum(int(v[j]) for v in set(map(tuple, x_of))) for j in range(fit.shape[1])]
    x = np.array([r[0] for r in rows], dtype=float)
    assert [r[1] for r in rows] == [sum((n * int(v) - s) ** 2 for v, s in zip(r[0], sums, strict=True)) for r in rows]
    want, got = (x - fit.mean(0)) @ vectors[:, :k] / np.sqrt(values[:k]), np.array([r[2] for r in rows])
    assert np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-7)


def test_operator_edges(spark):
    from jobloom.llm.whitening import whiten

    rng = np.random.default_rng(3)
    base = [[float(v) for v in rng.integers(-3, 4, 5) / 4 * s] for s in (1.0, 2.0) for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(base)] + [(None, base[0]), (7, base[0]), (7, base[0])]
    bad = [(100, None), (101, []), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [None, 1.0, 1.0, 1.0, 1.0]), (105, [1.0]), (106, [1.0] * 9)]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"x": F.lit("mine"), "n": F.lit(0)})
    out, model = whiten(d, components=3)
    got = out.collect()
    assert len(got) == len(rows) and {r.x for r in got} == {"mine"} and {r.n for r in got} == {model.n}
    x = [[int(np.floor(256 * c)) for c in r.embedding] for r in got]
    check([(v, r.deviation, r.whitened) for v, r in zip(x, got, strict=True)], model.n, model.identity_error, x, 3, model.explained)
    out, model = whiten(d.where("false"))
    assert out.count() == 0 and model is None
    # one vector, and vectors on a line: directions without variance are no components
    one, model = whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>"), components=4)
    assert [(r.n, r.deviation, r.whitened) for r in one.collect()] == [(1, 0, [])] * 3
    line, model = whiten(spark.createDataFrame([(i, [i / 256, 2 * i / 256]) for i in range(5)], "vec_id long, embedding array<double>"), components=4)
    assert all(len(r.whitened) == 1 for r in line.collect()) and abs(model.explained[0] - 1) < 1e-12 and model.identity_error < 1e-9
    # numbers beyond whole ones that a long holds
    huge, model = whiten(spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 3.0]), (3, [0.5, 2.0])], "vec_id long, embedding array<double>"), components=2)
    assert [r.deviation for r in huge.orderBy("vec_id").collect()] == [2**63 - 1, 2**63 - 1, 257**2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark):
    from jobloom.llm.whitening import op13_whitening

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r.vec_id: tuple(int(np.floor(256 * float(c))) for c in r.embedding) for r in rows}
    got = {}
    for r in op13_whitening(spark, SF).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == x.keys() and all(sorted(v) == [1, 2, 3, 4] for v in got.values())
    one = next(iter(got.values()))
    check([(x[i], v[1].deviation, [v[c].whitened for c in (1, 2, 3, 4)]) for i, v in got.items()], one[1].n, one[1].identity_error, list(x.values()), 4, [one[c].explained for c in (1, 2, 3, 4)])
