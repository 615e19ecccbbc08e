"""Bucketed search and ranks against all pairs."""

import numpy as np
import pytest

from tessera.operators import search as S


def clustered(seed, n, dim=8):
    """Vectors in tight clusters of very different norms, with ties."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim)) * r.choice([0.2, 1, 5], size=(6, 1))
    x = centres[r.integers(0, 6, n)] + r.normal(size=(n, dim)) * 0.02
    x[n // 2 : n // 2 + 5] = x[0]
    return x


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(S, "ROWS", 50)
    monkeypatch.setattr(S, "QUERIES", 7)
    monkeypatch.setattr(S, "TILE", 200)


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "id long, vec array<double>").repartition(3)


@pytest.mark.parametrize("k", [1, 4])
def test_top_products_equal_all_pairs(spark, small, k):
    x = clustered(1, 1500)
    got = {}
    rows = S.top_products(frame(spark, x[::50], range(0, 1500, 50)), frame(spark, x), k).collect()
    for r in rows:
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    for q in range(0, 1500, 50):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(s)), -s))[:k]
        assert np.allclose(s[[i for _, i in sorted(got[q])]], s[want])
    assert {r["compared"] for r in rows} and np.mean([r["compared"] for r in rows]) < 0.5 * len(x)


def test_ranks_equal_all_pairs(spark, small):
    x = clustered(2, 1200)
    q = x[::40] + np.random.default_rng(3).normal(size=x[::40].shape) * 0.01
    got = {r["id"]: r for r in S.product_ranks(frame(spark, q, range(0, 1200, 40)), frame(spark, x)).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, v in zip(range(0, 1200, 40), q, strict=True):
        s = unit @ v
        own, s[i] = s[i], -np.inf
        assert (got[i]["greater"], got[i]["not_less"]) == ((s > own + 1e-12).sum(), (s >= own - 1e-12).sum())
    assert np.mean([r["compared"] for r in got.values()]) < 0.5 * len(x)


def test_search_of_few_and_none(spark):
    x = clustered(4, 3)
    assert [r["id"] for r in S.top_products(frame(spark, x[:1]), frame(spark, x[:1]), 1).collect()] == []
    assert len(S.top_products(frame(spark, x[:1]), frame(spark, x), 5).collect()) == 2
    none = frame(spark, x).limit(0)
    assert S.top_products(frame(spark, x), none, 1).count() == 0 and S.product_ranks(frame(spark, x), none).count() == 0
