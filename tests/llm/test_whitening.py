"""Rank-one updates against a full decomposition, and the whitened rows against numpy over the distinct vectors."""

import numpy as np
import pytest

from netaccess.llm.whitening import Spectrum, rank_one, secular_roots, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string"


def normal(seed, n, dims):
    return np.random.default_rng(seed).normal(size=(n, dims)) * np.linspace(0.3, 3, dims)


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_secular_roots_and_update(k):
    r = np.random.default_rng(k)
    d, z = np.sort(r.normal(size=k) ** 2), r.normal(size=k)
    wanted = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
    if k > 1:
        pole, t = secular_roots(d, z * z)
        assert np.allclose(d[pole] + t, wanted, rtol=1e-12, atol=1e-13)
    values, vectors = rank_one(d, np.eye(k), z)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, np.diag(d) + np.outer(z, z), atol=1e-12)


@pytest.mark.parametrize("rows", [normal(1, 300, 7), np.repeat(np.eye(4) * 3, 5, axis=0), np.tile(normal(2, 20, 6), (1, 2)), np.ones((9, 3)), normal(3, 5, 12)])
def test_spectra_of_parts_combine_to_the_scatter(rows):
    parts = [Spectrum(rows.shape[1]) for _ in range(3)]
    for k, x in enumerate(rows):
        parts[k % 2].add(x)  # the third stays empty
    for other in parts[1:]:
        parts[0].combine(other)
    s, off = parts[0], rows - rows.mean(0)
    scatter = off.T @ off
    assert s.n == len(rows) and np.allclose(s.mean, rows.mean(0))
    assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, scatter, atol=1e-11 * max(1, np.abs(scatter).max()))
    assert np.allclose(s.vectors.T @ s.vectors, np.eye(rows.shape[1]), atol=1e-11)


def test_whitened_rows_equal_numpy(spark):
    cells = normal(4, 400, 6).astype(np.float32)
    rows = [(i, v.tolist(), 1, 5, "clash") for i, v in enumerate(cells)]
    rows += [(1000 + k, cells[7].tolist(), 1, 5, "copy") for k in range(200)] + [rows[3]]
    rows += [(2000, None, 1, 5, ""), (2001, [None] * 6, 1, 5, ""), (2002, [float("nan")] * 6, 1, 5, ""), (2003, [float("inf")] * 6, 1, 5, ""), (2004, [1.0, 2.0], 1, 5, ""), (2005, [], 1, 5, "")]
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    x = np.floor(256 * cells.astype(float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * (400 + 200 + 1)
    by_id = {i: int(v) for i, v in enumerate(((n * x - s) ** 2).sum(1))}
    for k in range(4):
        own = [r for r in got if r["component"] == k + 1]
        white = {i: (x[i] - s / n) @ vectors[:, k] / np.sqrt(values[k]) for i in range(400)}
        at = lambda r: r["vec_id"] if r["vec_id"] < 1000 else 7
        sign = np.sign(own[0]["whitened"] * white[at(own[0])])
        for r in own:
            assert abs(r["whitened"] * sign - white[at(r)]) < 1e-9 and r["n"] == n and r["deviation"] == by_id[at(r)]
            assert abs(r["explained"] - values[k] / values.sum()) < 1e-12 and r["identity_error"] < 1e-10


def test_rank_and_empty_tables(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, [0.5, 0.25], 1, 1, ""), (2, [0.5, 0.25], 1, 1, "")], SCHEMA)).collect() == []
    flat = [(i, [float(i), 2.0 * i, 1.0], 1, 1, "") for i in range(30)]
    got = whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 30 and all(abs(r["explained"] - 1) < 1e-12 for r in got)
