import math
import random

import numpy as np
import pytest

from tendon.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id string, n long, whitened double, component int, vector int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "clash", 3, 1.5, 2, None) for i, v in zip(ids, vectors)], SCHEMA).repartition(5)


def brute(vectors, components=32):
    """Plain eigenvectors of the covariance; the exact deviations by whole numbers."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(n * a - b) / n for a, b in zip(row, s)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1]
    deviations = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviations, centred, values[order][:components], axes[:, order][:, :components], values.sum()


def check(spark, vectors, components, tolerance=1e-8):
    t = table(spark, vectors)
    good = [(i, v) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = whitening.fitted(t)
    n, deviations, centred, values, axes, trace = brute([v for _, v in good])
    assert fit.n == n and len(fit.variances) == components
    assert np.allclose(fit.variances, values[:components], rtol=1e-9)
    assert np.allclose(np.abs((fit.components * axes[:, :components]).sum(axis=0)), 1, atol=1e-11)
    rows = whitening.whitened(t, fit).collect()
    assert len(rows) == n * components
    place = {i: k for k, (i, _) in enumerate(good)}
    for r in rows:
        k, c = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviations[k]
        want = centred[k] @ axes[:, c] / math.sqrt(values[c])
        assert abs(abs(r["whitened"]) - abs(want)) < tolerance * max(1, abs(want))
        assert math.isclose(r["explained"], values[c] / trace, rel_tol=1e-9)
    assert whitening.identity_error(t, fit) < 1e-9
    signs = [{np.sign(r["whitened"] * (centred[place[r["vec_id"]]] @ axes[:, c])) for r in rows if r["component"] == c + 1 and abs(r["whitened"]) > 1e-6} for c in range(components)]
    assert all(len(s) == 1 for s in signs)


def test_against_plain_eigenvectors(spark):
    rng = random.Random(1)
    vectors = [[rng.gauss(0, 1 + j / 5) + 3 * j for j in range(40)] for _ in range(300)]
    vectors[7], vectors[9], vectors[11], vectors[13] = None, [None] * 40, [math.nan] + [1.0] * 39, [1.0] * 39 + [math.inf]
    check(spark, vectors, 32)


def test_directions_without_variance_are_no_components(spark):
    rng = random.Random(2)
    vectors = []
    for _ in range(120):
        a, b, c = (rng.randint(-400, 400) for _ in range(3))
        vectors.append([a / 64, b / 64, (a + b) / 64, 2 * a / 64, 5.0, c / 64])
    check(spark, vectors, 3)


def test_variances_of_very_different_size(spark):
    rng = random.Random(3)
    check(spark, [[rng.gauss(0, 10.0**j) for j in range(5)] for _ in range(400)], 5, 1e-6)


def test_repeated_rows_null_ids_and_other_lengths(spark):
    vectors = [[1.0, 2.0, 3.0]] * 50 + [[2.0, 1.0, 0.5], [0.0, 0.0, 1.0]] + [[1.0, 2.0]] * 3 + [[], None]
    t = table(spark, vectors, [None if i % 2 else 1 for i in range(len(vectors))])
    fit = whitening.fitted(t)
    assert fit.n == 52 and len(fit.sums) == 3 and len(fit.variances) == 2
    rows = whitening.whitened(t, fit).collect()
    assert len(rows) == 104 and {r["vec_id"] for r in rows} == {None, 1}
    assert whitening.identity_error(t, fit) < 1e-10


@pytest.mark.parametrize("vectors", [[], [None, [math.nan]], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [[]]])
def test_nothing_to_whiten(spark, vectors):
    t = table(spark, vectors)
    rows = whitening.whitened(t, whitening.fitted(t))
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained"] and rows.collect() == []


def test_long_vectors_and_large_numbers(spark):
    rng = random.Random(4)
    vectors = [[rng.gauss(0, 1e9) for _ in range(3)] for _ in range(40)] + [[1e300, 0.0, 0.0]]
    t = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    fit = whitening.fitted(t)
    assert fit.n == 40  # 64 times the last entry is no whole number that a double holds exactly
    assert whitening.identity_error(t, fit) < 1e-9
    assert all(r["deviation"] is None for r in whitening.whitened(t, fit).collect())
    wide = [[rng.gauss(0, 1) for _ in range(300)] for _ in range(330)]
    fit = whitening.fitted(table(spark, wide))
    assert len(fit.variances) == 32 and whitening.identity_error(table(spark, wide), fit) < 1e-9


def test_triangular_solves():
    rng = np.random.default_rng(5)
    upper = np.triu(rng.normal(size=(70, 70))) + 9 * np.eye(70)
    rows = rng.normal(size=(11, 70))
    assert np.allclose(whitening._solved(rows, upper) @ upper, rows)
