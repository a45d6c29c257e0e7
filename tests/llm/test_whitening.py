"""Spectra against numpy, and whitened vectors against the plain definition."""

import math

import numpy as np
import pytest

from marquee.llm import whitening as w

SCHEMA = "vec_id bigint, embedding array<float>, vector int, part string, n int"


def scatter(rows):
    centred = rows - rows.mean(axis=0)
    return centred.T @ centred


def matrix(s):
    return s.vectors @ np.diag(s.values) @ s.vectors.T


@pytest.mark.parametrize("seed", range(60))
def test_spectrum(seed):
    rnd = np.random.default_rng(seed)
    width = int(rnd.integers(1, 14))
    rows = rnd.integers(-64, 64, (int(rnd.integers(2, 60)), width)).astype(float)
    if seed % 3 == 0:
        rows[:, : max(1, width // 2)] = 7  # no variance there
    if seed % 5 == 0:
        rows = rows[:1].repeat(len(rows), axis=0)
    if seed % 7 == 0:
        rows[:, -1] = rows[:, 0]
    if seed % 4 == 0:
        rows *= 10.0 ** rnd.integers(-6, 6, width)
    whole = w.Spectrum(width)
    for part in np.array_split(rows, 3):
        if len(part):
            whole.add(part)
    left, right = w.Spectrum(width), w.Spectrum(width)
    left.add(rows[: len(rows) // 2])
    right.add(rows[len(rows) // 2 :])
    left.join(right)
    wanted = scatter(rows)
    size = max(1.0, np.abs(wanted).max())
    for found in (whole, left):
        assert found.n == len(rows)
        assert np.allclose(found.mean, rows.mean(axis=0))
        assert np.abs(matrix(found) - wanted).max() < 1e-11 * size * width
        assert np.abs(found.vectors.T @ found.vectors - np.eye(width)).max() < 1e-12


def test_rank_one_update_is_exact_on_separate_and_equal_eigenvalues():
    rnd = np.random.default_rng(1)
    for values in ([0.0, 0.0, 0.0], [1.0, 1.0, 2.0], [1.0, 1 + 1e-15, 1 + 1e-9], [0.0, 1e-300, 1e10]):
        q, _ = np.linalg.qr(rnd.standard_normal((3, 3)))
        row = rnd.standard_normal(3)
        wanted = q @ np.diag(values) @ q.T + 0.5 * np.outer(row, row)
        found, vectors = w.rank_one(np.array(values), q, row, 0.5)
        assert np.allclose(found, np.linalg.eigvalsh(wanted), rtol=1e-12, atol=1e-14 * max(values + [1]))
        assert np.abs(vectors.T @ vectors - np.eye(3)).max() < 1e-14


def plain(vectors):
    width = max(map(len, vectors))
    rows = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        rows[i, : len(v)] = np.floor(64 * np.asarray(v, np.float64))
    n = len(rows)
    centred = rows - rows.mean(axis=0)
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    ints = rows.astype(object)
    sums = ints.sum(axis=0)
    deviation = [int(sum((n * x - s) ** 2 for x, s in zip(r, sums))) for r in ints]
    return n, deviation, centred @ basis, values


def collected(df):
    rows = w.whiten(df).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    return rows, by_id


def test_against_numpy(spark):
    rnd = np.random.default_rng(4)
    mix = rnd.standard_normal((40, 40)) * np.linspace(0.1, 2, 40)
    vectors = [v.astype(np.float32).tolist() for v in rnd.standard_normal((700, 40)) @ mix + 3]
    rows = [(i, v, 0, "", 0) for i, v in enumerate(vectors)]
    bad = [(900, None, 0, "", 0), (901, [None] * 40, 0, "", 0), (902, [float("nan")] * 40, 0, "", 0),
           (903, [float("inf")] + [0.0] * 39, 0, "", 0), (904, [3e38] * 40, 0, "", 0)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(37)
    found, by_id = collected(df)
    n, deviation, projected, values = plain(vectors)
    assert len(found) == n * w.COMPONENTS and set(by_id) == set(range(n))
    white = np.array([[by_id[i][c]["whitened"] for c in range(1, 33)] for i in range(n)])
    wanted = projected[:, :32] / np.sqrt(values[:32])
    assert np.abs(np.abs(white) - np.abs(wanted)).max() < 1e-8
    signs = np.sign((white * wanted).sum(axis=0))
    assert np.abs(white - signs * wanted).max() < 1e-8
    assert [by_id[i][1]["deviation"] for i in range(n)] == deviation
    assert {r["n"] for r in found} == {n}
    for c in range(1, 33):
        assert math.isclose(by_id[0][c]["explained"], values[c - 1] / values.sum(), rel_tol=1e-9)
    assert 0 <= found[0]["identity_error"] < 1e-10
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]}


def test_flat_directions_and_odd_rows(spark):
    rows = [(1, [1.0, 5.0, 1.0], 0, "", 0), (1, [1.0, 7.0, 1.0], 0, "", 0), (None, [1.0, 5.0], 0, "", 0),
            (2, [], 0, "", 0), (3, [0.0, 0.0, 0.0], 0, "", 0)]
    found = w.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 5 * 3 and all(math.isfinite(r["whitened"]) for r in found)
    assert found[0]["identity_error"] < 1e-9
    alone = w.whiten(spark.createDataFrame(rows[:1] * 3, SCHEMA)).collect()
    assert len(alone) == 9
    assert all((r["whitened"], r["explained"], r["deviation"]) == (0.0, 0.0, 0) for r in alone)
    assert w.whiten(spark.createDataFrame(rows[3:4], SCHEMA)).count() == 0
    assert w.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [2.0**28], 0, "", 0), (2, [-(2.0**28)], 0, "", 0), (3, [0.0], 0, "", 0)]
    found = {r["vec_id"]: r["deviation"] for r in w.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: None, 2: None, 3: 0}
