"""Merged factorisations against one factorisation of all rows."""

import numpy as np
import pytest

from tessera.operators.components import Factors, fit_components, project


def spread(n: int, d: int = 12, seed: int = 3) -> np.ndarray:
    r = np.random.default_rng(seed)
    return r.normal(size=(n, d)) * np.linspace(4, 0.1, d) + r.normal(size=d) * 5


def whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return s**2, v


def test_full_rank_equals_one_batch(spark):
    x = spread(500)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(7)
    f = fit_components(df, "v", keep=12, batch=20, fan=3)
    values, v = whole(x)
    assert f.n == 500 and f.lost == 0
    np.testing.assert_allclose(f.mean, x.mean(axis=0))
    np.testing.assert_allclose(f.values, values)
    np.testing.assert_allclose(np.abs(f.directions(5)), np.abs(v[:5]), atol=1e-8)
    got = {r["id"]: r["p"] for r in project(df, "v", f, 3).collect()}
    np.testing.assert_allclose(np.array([got[i] for i in range(500)]), (x - x.mean(axis=0)) @ f.directions(3).T, atol=1e-8)


@pytest.mark.parametrize("keep", [1, 3, 8])
@pytest.mark.parametrize("size", [5, 40])
def test_what_is_lost_bounds_the_error(keep, size):
    x = spread(300)
    state = None
    for at in range(0, len(x), size):
        one = Factors.of(x[at : at + size], keep)
        state = one if state is None else state.merged(one, keep)
    values, _ = whole(x)
    gap = values[:keep] - state.values
    assert state.lost > 0 and (gap >= -1e-8).all() and (gap <= state.lost + 1e-8).all()
    np.testing.assert_allclose(state.mean, x.mean(axis=0))


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("-inf"), 1.0]), (5, [None, 1.0]), (6, [3.0, 2.0]), (6, [3.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    f = fit_components(df, "v", keep=2)
    assert f.n == 3 and f.mean.tolist() == pytest.approx([7 / 3, 2])
    assert f.directions(2).tolist() == [pytest.approx([1, 0]), pytest.approx([0, 0])] or f.directions(1).tolist() == [pytest.approx([1, 0])]
    got = [(r["id"], r["p"] and round(r["p"][0], 6)) for r in project(df, "v", f, 1).orderBy("id").collect()]
    assert got == [(1, -1.333333), (2, None), (3, None), (4, None), (5, None), (6, 0.666667), (6, 0.666667)]
    assert fit_components(df.limit(0), "v", keep=2) is None
