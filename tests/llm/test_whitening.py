import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunewright.llm import whitening


@pytest.fixture(autouse=True)
def packaged(documents):
    return documents


def table(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


def exact(rows):
    """Kept rows as integers, n, sums, and the covariance in whole-number arithmetic."""
    kept = []
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]))
    n = len(kept)
    sums = [sum(column) for column in zip(*(x for _, x in kept), strict=True)]
    away = [[n * a - s for a, s in zip(x, sums, strict=True)] for _, x in kept]
    d = len(sums)
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in away), n**3)) for j in range(d)] for i in range(d)])
    return kept, n, sums, away, cov


def check(got, rows, components=32, regular=True):
    kept, n, sums, away, cov = exact(rows)
    d = len(sums)
    k = min(components, d)
    assert len(got) == n * k
    # Singular values keep small eigenvalues that a covariance in doubles has lost.
    values = np.zeros(d)
    found = np.linalg.svd(np.array(away, dtype=float) / n, compute_uv=False) ** 2 / n
    values[:len(found)] = found
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, set()).add(r.whitened)
        assert r.n == n
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10, abs=1e-13)
    white = []
    for (i, _), row in zip(kept, away, strict=True):
        here = by_row[i, sum(a * a for a in row)]
        assert sorted(here) == list(range(1, k + 1))
        white.append([min(here[c], key=lambda v: v if v is not None else 0.0) for c in range(1, k + 1)])
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    if regular:
        # The projections are those on unit eigenvectors, up to a sign, where these are unique.
        y = np.array(away, dtype=float) / n
        w = np.array(white)
        vectors = np.linalg.lstsq(y, w * np.sqrt(values[:k]), rcond=None)[0]
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-9
        assert np.abs(cov @ vectors - vectors * values[:k]).max() < 1e-10 * values[0]
        centred = w - w.mean(axis=0)
        assert np.abs(centred.T @ centred / n - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize("rows, dims", [(300, 40), (90, 5), (50, 1)])
def test_against_whole_number_arithmetic(spark, rows, dims):
    rng = np.random.default_rng(dims)
    mixed = rng.normal(size=(rows, dims)) @ rng.normal(size=(dims, dims)) + 30 * rng.normal(size=dims)
    data = [(i, [float(c) for c in v]) for i, v in enumerate(mixed.astype(np.float32))]
    check(whitening.whitened_vectors(table(spark, data, x="x", component=7, n=1)).collect(), data)


def test_nearly_dependent_dimensions(spark):
    rng = np.random.default_rng(5)
    base = 20_000 * rng.normal(size=(400, 3))
    # The fourth dimension differs from a sum of two others by single steps of the integers.
    data = [(i, [float(c) for c in (*v, v[0] + v[1] + 0.03 * rng.normal())]) for i, v in enumerate(base)]
    check(whitening.whitened_vectors(table(spark, data)).collect(), data)


def test_dependent_and_constant_dimensions_have_no_whitened_value(spark):
    rng = np.random.default_rng(6)
    base = np.round(64 * rng.normal(size=(60, 2))) / 64
    data = [(i, [float(a), float(b), float(a + b), 3.0]) for i, (a, b) in enumerate(base)]
    got = whitening.whitened_vectors(table(spark, data)).collect()
    check(got, data, regular=False)
    assert {r.component for r in got if r.whitened is None} == {3, 4}
    assert {r.component for r in got if r.explained < 1e-12} == {3, 4}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, -inf]), (7, [0.5, -0.01]),
            (None, [3.0, 1.5]), (8, [0.0, 9.0]), (8, [0.0, 9.0]), (9, [-4.0, 2.25])]
    got = whitening.whitened_vectors(table(spark, data)).collect()
    assert sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 8 for r in got) == 4
    assert {r.vec_id for r in got} == {1, 7, 8, 9, None}
    distinct = [r for r in got if r.vec_id != 8]
    assert len(distinct) == 8
    check(got, data)


def test_single_row_empty_table_and_lengths(spark):
    assert whitening.whitened_vectors(table(spark, [])).collect() == []
    assert whitening.whitened_vectors(table(spark, [(1, []), (2, None)])).collect() == []
    got = whitening.whitened_vectors(table(spark, [(1, [2.0, 3.0])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained) for r in sorted(got, key=lambda r: r.component)] == \
        [(1, 0, None, None), (2, 0, None, None)]
    mixed = [(1, [2.0, 3.0]), (2, [1.0]), (3, [4.0, 4.5]), (4, [1.0, 2.0, 3.0])]
    assert {r.vec_id for r in whitening.whitened_vectors(table(spark, mixed)).collect()} == {1, 3}


def test_deviations_past_64_bits_stay_exact(spark):
    far = [(i, [float(np.float32(3e12 * (i % 3))), float(i)]) for i in range(9)]
    kept, n, sums, away, _ = exact(far)
    got = {r.vec_id: int(r.deviation) for r in whitening.whitened_vectors(table(spark, far)).collect()}
    assert got == {i: sum(a * a for a in row) for (i, _), row in zip(kept, away, strict=True)}
    assert max(got.values()) > 2**63


def test_partial_matrices_in_two_steps(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(80, 3)))]
    rows = whitening.integer_rows(table(spark, data)).repartition(7)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    x = np.array([r.x for r in rows.collect()])
    assert (whitening.gram(rows, 3, lambda m: m - 1_000_000.0) == (x - 1_000_000).T @ (x - 1_000_000)).all()


def test_triangular_solves():
    rng = np.random.default_rng(9)
    y, r, s = rng.normal(size=(20, 6)), np.triu(rng.normal(size=(6, 6))) + 4 * np.eye(6), np.triu(rng.normal(size=(6, 6))) + 4 * np.eye(6)
    assert np.allclose(whitening.solved(y, [r, s]), y @ np.linalg.inv(r) @ np.linalg.inv(s))
