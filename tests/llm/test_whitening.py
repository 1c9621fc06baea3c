"""Whitening against a covariance in exact fractions and numpy's eigenvectors, defined cases, and hard numbers."""

from fractions import Fraction

import numpy as np
import pytest

from siteglass.llm import shifted_qr as Q

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n") for i, v in rows], SCHEMA)


def whole(v):
    return [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]


def expected(vectors):
    """n, sums, eigenvalues and vectors of the distinct whole vectors, centred exactly."""
    fit = sorted({tuple(whole(v)) for v in vectors})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    _, singular, right = np.linalg.svd(centred, full_matrices=False)
    return n, sums, singular**2 / n, right.T


def check(got, rows, width, components=16):
    n, sums, values, vectors = expected([v for _, v in rows])
    rank = int((values > 1e-16 * values[0]).sum())
    kept = min(components, rank)
    assert len(got) == len(rows) * kept
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    signs = None
    for i, v in rows:
        far = [n * c - s for c, s in zip(whole(v), sums)]
        want = np.array([float(Fraction(f, n)) for f in far]) @ vectors[:, :kept] / np.sqrt(values[:kept])
        found = np.array([by_id[i][k + 1].whitened for k in range(kept)])
        if signs is None:
            signs = np.where(want * found < 0, -1, 1)
        assert np.allclose(found * signs, want, atol=1e-7), i
        r = by_id[i][1]
        exact = sum(f * f for f in far)
        assert r.n == n and r.deviation == (exact if exact < 2**63 else None) and r.identity_error < 1e-8
        assert [by_id[i][k + 1].explained for k in range(kept)] == pytest.approx((values[:kept] / values.sum()).tolist(), rel=1e-8)


def random_rows(n, width, seed=2, spread=1.0):
    draw = np.random.default_rng(seed)
    mixed = draw.normal(size=(width, width)) * np.geomspace(spread, 0.05, width)[:, None]
    return [(i, (draw.normal(size=width) @ mixed).tolist()) for i in range(n)]


def test_equals_numpy(spark):
    rows = random_rows(500, 24)
    check(Q.whiten(frame(spark, rows)).collect(), rows, 24)


def test_ill_conditioned_rows_need_the_later_passes(spark):
    rows = random_rows(300, 12, spread=5e4)
    got = Q.whiten(frame(spark, rows)).collect()
    check(got, rows, 12)
    assert got[0].identity_error < 1e-8


def test_copies_count_once_in_the_fit_and_all_come_out(spark):
    rows = random_rows(60, 8)
    many = rows + [(1000 + i, rows[3][1]) for i in range(200)]
    check(Q.whiten(frame(spark, many)).collect(), many, 8)
    repeated = Q.whiten(frame(spark, rows + rows[:10])).collect()
    assert len(repeated) == 70 * 8 and len({(r.vec_id, r.component, r.whitened) for r in repeated}) == 60 * 8


def test_fewer_directions_than_dimensions(spark):
    rows = [(i, [*v, 7.0, 0.0]) for i, v in random_rows(50, 4)]
    check(Q.whiten(frame(spark, rows)).collect(), rows, 6)
    few = random_rows(5, 20)
    check(Q.whiten(frame(spark, few)).collect(), few, 20)


def test_defined_cases(spark):
    rows = random_rows(40, 5)
    bad = [(900, None), (901, []), (902, [None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("-inf")] * 5), (905, [1.0])]
    check(Q.whiten(frame(spark, rows + bad)).collect(), rows, 5)
    assert Q.whiten(frame(spark, [])).count() == 0
    assert Q.whiten(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])).count() == 0
    unnamed = Q.whiten(frame(spark, [*rows, (None, rows[0][1])])).collect()
    assert sum(r.vec_id is None for r in unnamed) == 5


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(i, [float(i * 10**6), 1e13 if i == 3 else 0.0]) for i in range(30)]
    got = {r.vec_id: r.deviation for r in Q.whiten(frame(spark, rows)).collect()}
    n, sums, *_ = expected([v for _, v in rows])
    exact = {i: sum((n * c - s) ** 2 for c, s in zip(whole(v), sums)) for i, v in rows}
    assert any(d >= 2**63 for d in exact.values()) and got == {i: d if d < 2**63 else None for i, d in exact.items()}
