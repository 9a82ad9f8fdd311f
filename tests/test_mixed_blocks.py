"""The mixed model in blocks against the dense fit."""

import numpy as np
import pytest

from locusframe.operators import mixed, mixed_blocks


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 44
    d = rng.integers(0, 3, (n, 150)).astype(float)
    d[1::2] = d[::2] * 0.8 + 0.2 * d[1::2]
    w = d - d.mean(0)
    k = w @ w.T / 150
    cells = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(n) for j in range(i + 1)], "i long, j long, value double").cache()
    return n, k, 3 + rng.multivariate_normal(np.zeros(n), 2 * k) + rng.normal(0, 0.7, n), cells, rng.normal(size=n)


@pytest.mark.parametrize("width, tile", [(8, 10), (64, 512)])
def test_same_components_as_the_dense_fit(spark, data, width, tile):
    n, k, y, cells, c = data
    rows = [(t, float(y[t]), float(c[t]), 2.0) for t in range(n - 4)] + [(7, 1.5, 0.2, 2.0), (9999, 1.0, 1.0, 2.0), (n - 1, None, 0.0, 2.0)]
    trait = spark.createDataFrame(rows, "taxon long, y double, c double, same double")
    places = [*range(n - 4), 7]
    x, ys = np.array([[1.0, r[2]] for r in rows[: n - 3]]), np.array([r[1] for r in rows[: n - 3]])
    want = mixed.restricted_fit(ys, x, k[np.ix_(places, places)])
    model = mixed_blocks.mixed_model(cells, trait, ["c"], width, tile)
    got = model.found
    assert model.n == n - 3
    for name in ("delta", "genetic", "residual", "lnl"):
        assert got[name] == pytest.approx(want[name], rel=1e-6)
    assert got["beta"] == pytest.approx(want["beta"], rel=1e-6)
    u = {r["taxon"]: r["blup"] for r in model.genetic_values().collect()}
    full = k[:, places] @ np.linalg.solve(k[np.ix_(places, places)] + want["delta"] * np.eye(len(ys)), ys - x @ want["beta"])
    assert len(u) == n and np.allclose([u[t] for t in range(n)], full, atol=1e-6)


def test_low_rank_and_degenerate_traits(spark, data):
    n, k, y, cells, c = data
    f = np.column_stack([np.repeat([0.0, 1.0], n // 2), np.arange(n) % 3])
    low = f @ f.T
    thin = spark.createDataFrame([(i, j, float(low[i, j])) for i in range(n) for j in range(i + 1) if low[i, j]] + [(0, 0, 0.0)], "i long, j long, value double")
    trait = spark.createDataFrame([(t, float(y[t]), 1.0) for t in range(n)], "taxon long, y double, one double")
    got = mixed_blocks.mixed_model(thin, trait, width=8, tile=16)
    places = sorted({*np.flatnonzero(low.any(1)), 0})
    want = mixed.restricted_fit(y[places], np.ones((len(places), 1)), low[np.ix_(places, places)])
    assert got.n == len(places) and got.found["lnl"] == pytest.approx(want["lnl"], rel=1e-6) and got.found["delta"] == pytest.approx(want["delta"], rel=1e-5)
    flat = spark.createDataFrame([(t, 1.0) for t in range(n)], "taxon long, y double")
    assert mixed_blocks.mixed_model(cells, flat).row() == (n, *[None] * 6)
    assert mixed_blocks.mixed_model(cells, flat.where("taxon < 2")).row() == (2, *[None] * 6)
