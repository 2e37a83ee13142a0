"""Rates of low rank: against a dense solver by other means, and by the conditions that hold at the optimum."""

import numpy as np
import pytest

from tests.conftest import SF
from tessera.jobs import low_rank_rates as lrr


def dense(y, lam, link, steps=6000):
    """Proximal gradient descent with halved steps over one dense matrix: the objective it ends with."""
    f, seen = lrr.LINKS[link], np.isfinite(y)
    counts = np.where(seen, y, 0.0)
    loss = lambda x: np.where(seen, f.rate(x) - counts * f.log_rate(x), 0.0).sum()
    low, d, size = np.zeros_like(y), np.full(y.shape[1], 0.5), 1.0
    for _ in range(steps):
        g = np.where(seen, f.slopes(low + d, counts)[0], 0.0)
        while True:
            u, s, v = np.linalg.svd(low - size * g, full_matrices=False)
            new, nd = (u * np.maximum(s - size * lam, 0)) @ v, d - size * g.sum(0) / len(y)
            move = np.vstack([new - low, np.sqrt(len(y)) * (nd - d)])
            linear = (g * (new - low)).sum() + (g.sum(0) * (nd - d)).sum()
            if loss(new + nd) <= loss(low + d) + linear + (move**2).sum() / (2 * size) + 1e-12:
                break
            size /= 2
        low, d = new, nd
    return loss(low + d) + lam * np.linalg.svd(low - low.mean(0), compute_uv=False).sum(), low + d


def planted(hidden=0.0, steps=60, p=6):
    rng = np.random.default_rng(4)
    x = np.sin(np.arange(steps) / 4)[:, None] * rng.standard_normal(p) + 0.8
    y = rng.poisson(np.exp(x)).astype(float)
    y[rng.random(y.shape) < hidden] = np.nan
    return x, y


def panel(spark, y, trials=3):
    each = len(y) // trials
    rows = [(k // each, 2 + k % each, v, None if np.isnan(y[k, v]) else float(y[k, v])) for k in range(len(y)) for v in range(y.shape[1])]
    return spark.createDataFrame(rows, "trial int, t int, var int, y double")


def matrix(made):
    rows = sorted(made.rates.collect(), key=lambda r: (r.trial, r.t))
    return np.array([r.x for r in rows])


@pytest.mark.parametrize(("link", "hidden", "strength"), [("softplus", 0.0, 0.3), ("exp", 0.1, 1.0)])
def test_objective_is_that_of_a_dense_solver(spark, link, hidden, strength):
    _, y = planted(hidden)
    made = lrr.fit(panel(spark, y), 6, strength=strength, link=link, eps_rel=1e-5)
    lam = strength * np.sqrt(y.size)
    want, rates = dense(y, lam, link)
    assert abs(made.trace[-1][0] - want) < 1e-4 * abs(want)
    assert np.abs(matrix(made) - rates).max() < 0.02
    assert np.linalg.matrix_rank(rates - rates.mean(0), tol=1e-3) == (made.shrunk.values > 1e-3).sum() < 6


def test_states_of_a_start_model(spark):
    x, y = planted(steps=120)
    made = lrr.fit(panel(spark, y), 6, strength=0.2, link="exp")
    model = lrr.start_model(made, 1)
    assert abs(np.corrcoef(model.C[:, 0], x[6] - x[0])[0, 1]) > 0.9
    assert 0.8 < model.A[0, 0] < 1.0 and model.Q[0, 0] > 0


def test_silent_and_unseen_variables(spark):
    _, y = planted()
    y[:, 2], y[:, 4] = 0.0, np.nan
    made = lrr.fit(panel(spark, y), 7, strength=0.3, rounds=20)
    got = matrix(made)
    assert made.kept == [0, 1, 3, 5] and np.isfinite(got[:, made.kept]).all()
    assert (got[:, 2] == -np.inf).all() and np.isnan(got[:, [4, 6]]).all()


def test_empty_panels(spark):
    _, y = planted()
    for given in (panel(spark, y).limit(0), panel(spark, 0 * y)):
        made = lrr.fit(given, 6)
        assert made.rates.columns == ["trial", "t", "x"] and made.rates.count() == 0 and made.trace == []


@pytest.mark.parametrize("link", ["exp", "softplus"])
@pytest.mark.parametrize("rho", [1e-3, 1.0, 1e3])
def test_cells_end_with_no_slope(link, rho):
    rng = np.random.default_rng(1)
    y, target = rng.poisson(3.0, (50, 4)) * 10.0 ** rng.integers(0, 4, (50, 4)), rng.normal(0, 6, (50, 4))
    y[0, 0] = np.nan
    x = lrr.nearest(lrr.LINKS[link], y, target, rho)
    g = lrr.LINKS[link].slopes(x, np.nan_to_num(y))[0] + rho * (x - target)
    assert x[0, 0] == target[0, 0] and np.abs(g[1:] / (1 + y[1:] + rho * np.abs(target[1:]))).max() < 1e-9


def test_query_is_optimal(spark):
    """At the optimum the slopes have no sum by variable, no singular value beyond lam, and lam along the rates' own directions."""
    from tessera.jobs.queries import masked_counts
    from tessera.jobs.state_queries import QUERIES

    rows = QUERIES["low_rank_rates"](spark, SF).toPandas().pivot(index=["trial", "t"], columns="var", values="x")
    y = masked_counts(spark, SF).toPandas().pivot(index=["trial", "t"], columns="var", values="y").reindex(rows.index)
    x, y = rows.to_numpy(), y.to_numpy(float)
    slope = np.where(np.isfinite(y), lrr.LINKS["softplus"].slopes(x, np.nan_to_num(y))[0], 0.0)
    lam, low = 0.1 * np.sqrt(x.size), x - x.mean(0)
    assert len(rows) == len(y) > 0 and np.abs(slope.sum(0)).max() < 0.01 * lam * np.sqrt(len(x))
    assert np.linalg.svd(slope, compute_uv=False)[0] < 1.01 * lam
    assert np.isclose(-(slope * low).sum(), lam * np.linalg.svd(low, compute_uv=False).sum(), rtol=0.01, atol=0.01 * lam)


def test_rounds_are_shared_out(spark):
    """Rows of few bytes, whose rounds are work, are not left to one task."""
    rows = [(k, t, v, float((k + t * v) % 4)) for k in range(10) for t in range(6) for v in range(3)]
    made = lrr.fit(spark.createDataFrame(rows, "trial int, t int, var int, y double"), 3, strength=0.1, rounds=2)
    assert made.rates.count() == 60
    assert made.rates.rdd.getNumPartitions() >= 3
