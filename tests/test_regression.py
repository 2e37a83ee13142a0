"""Count regressions at any level of counts, and panels with gaps or long segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import lagcov, learning, panel


def newton(z, y, offset, P):
    """A dense optimum, from the best of several starts."""
    b = np.linalg.lstsq(z, np.log(np.maximum(y, 0.5)) - offset, rcond=None)[0]
    loss = lambda b: (np.exp(z @ b + offset) - y * (z @ b + offset)).sum() + b @ P @ b / 2
    for _ in range(200):
        rate = np.exp(z @ b + offset)
        step = np.linalg.solve(z.T @ (z * rate[:, None]) + P, z.T @ (y - rate) - P @ b)
        scale = 1.0
        while loss(b + scale * step) > loss(b) and scale > 1e-12:
            scale /= 2
        b = b + scale * step
    return b, loss(b)


@pytest.mark.parametrize(("p", "penalty"), [(2, 0.1), (5, 0.5), (6, learning.smoothness(6, 3.0, 0.01))])
def test_poisson_regression_finds_the_optimum(spark, p, penalty):
    rng = np.random.default_rng(p)
    P = penalty * np.eye(p) if np.ndim(penalty) == 0 else penalty
    rows, want = [], {}
    for var, mean in enumerate((0.0, 0.3, 30.0, 30_000.0)):
        z = np.column_stack([np.ones(80), 0.5 * rng.standard_normal((80, p - 1))])
        offset = 0.2 * rng.standard_normal(80)
        y = rng.poisson(mean * np.exp(z[:, 1] * 0.4 + offset)).astype(float)
        want[var] = newton(z, y, offset, P)
        rows += [(var, float(a), b.tolist(), float(c)) for a, b, c in zip(y, z, offset, strict=True)]
    rows += [(0, None, [1.0] * p, 0.0), (0, 1.0, None, 0.0), (0, 1.0, [1.0] * p, None)]
    given = spark.createDataFrame(rows, "var int, y double, z array<double>, offset double")
    got = {r["var"]: r for r in learning.poisson_regression(given, p, penalty=penalty).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for var, (b, loss) in want.items():
        assert got[var]["n"] == 80 and got[var]["slope"] < 1e-2 * max(1, 10 ** (var - 1)) and np.allclose(got[var]["b"], b, atol=1e-4) and np.isclose(got[var]["loss"], loss, rtol=1e-7)
    assert learning.poisson_regression(given.limit(0), p).count() == 0


def test_observation_step_with_spread_and_history(spark):
    """Loadings, offsets and history weights have no slope left by differences, over steps that have all they need."""
    rng = np.random.default_rng(1)
    n, past, steps = 2, 3, 60
    x, root = rng.standard_normal((2, steps, n)), 0.3 * rng.standard_normal((2, steps, n, n))
    v = root @ root.transpose(0, 1, 3, 2)
    y = rng.poisson(np.exp(0.5 * x[:, :, :1] + np.array([0.0, 1.0, 3.0]))).astype(float)
    y[rng.random(y.shape) < 0.1] = np.nan
    states = spark.createDataFrame([(a, t, x[a, t].tolist(), v[a, t].ravel().tolist()) for a, t in np.ndindex(2, steps) if t != 30], "trial int, t int, x array<double>, v array<double>")
    cells = spark.createDataFrame([(a, t, k, float(y[a, t, k]) if np.isfinite(y[a, t, k]) else None) for a, t, k in np.ndindex(y.shape)], "trial int, t int, var int, y double")
    got = {r["var"]: r for r in learning.observation_step(cells, states, n, past=past, penalty=0.2).collect()}
    assert sorted(got) == [0, 1, 2]
    for k, r in got.items():
        use = [(a, t) for a in range(2) for t in range(past, steps) if t != 30 and np.isfinite(y[a, t - past : t + 1, k]).all()]
        z = np.array([[*x[a, t], 1.0, *y[a, t - past : t, k][::-1]] for a, t in use])
        m, c = np.array([v[a, t] for a, t in use]), np.array([y[a, t, k] for a, t in use])
        loss = lambda b: (np.exp(z @ b + 0.5 * np.einsum("i,rij,j->r", b[:n], m, b[:n])) - c * (z @ b)).sum() + 0.1 * b @ b  # noqa: B023, E731
        b = np.array([*r["c"], r["d"], *r["w"]])
        slope = [(loss(b + 1e-5 * e) - loss(b - 1e-5 * e)) / 2e-5 for e in np.eye(n + 1 + past)]
        assert r["n"] == len(use) and np.isclose(r["loss"], loss(b), rtol=1e-9) and np.abs(slope).max() < 1e-3 * max(1, np.abs(z.T @ c).max() / 100)
    assert learning.observation_step(cells, states.limit(0), n, past=past).count() == 0
    plain = {r["var"]: r for r in learning.observation_step(cells, states, n).collect()}
    assert all(len(r["w"]) == 0 and r["n"] > got[k]["n"] for k, r in plain.items())


def test_windows_with_unseen_cells_keep_their_scale(spark):
    """Half of the cells unseen: covariances of the products that are left, not shrunk by those that are not."""
    rng, k = np.random.default_rng(0), 2
    y = rng.standard_normal((3, 40, 2)) + 5
    y[rng.random(y.shape) < 0.5] = np.nan
    rows = [(a, t, v, float(y[a, t, v])) for a, t, v in np.ndindex(y.shape) if np.isfinite(y[a, t, v])]
    rows += [(a, 39, v, None) for a in range(3) for v in range(2) if np.isnan(y[a, 39, v])]
    got = {(r.r, r.c, r.i, r.j): r.q for r in lagcov.window_cov(spark.createDataFrame(rows, "trial int, t int, var int, y double"), 2, k).collect()}
    z = y - np.nanmean(y, axis=1, keepdims=True)
    for r, c, i, j in np.ndindex(k, k, 2, 2):
        windows = 39 + 2 - 2 * k
        now, before = z[:, k + r : k + r + windows, i], z[:, k - 1 - c : k - 1 - c + windows, j]
        assert np.isclose(got[r, c, i, j], np.nanmean(now * before))


def test_sample_covariances_refuse_gaps(spark):
    rows = [(0, t, v, float(t * v)) for t in range(10) for v in range(2) if (t, v) != (4, 1)]
    with pytest.raises(ValueError, match="every cell"):
        lagcov.sample_cov(spark.createDataFrame(rows, "trial int, t int, var int, y double"), 2, 1, 1)


def test_schemes_of_very_long_and_very_short_segments(spark):
    far = 1 << 31
    schedule = [(0, 0, far, 0), (1, far, far + 1, 1), (2, far + 1, far + 2, 0), (3, far + 2, far + 10, 1), (4, far + 20, far + 20, 0), (5, far + 30, 2 * far, 1)]
    members = [(0, 0), (0, 1), (1, 1), (1, 2)]
    steps = [0, 1, far // 3, far - 1, far, far + 1, far + 2, far + 9, far + 10, far + 20, far + 29, far + 30, 2 * far - 1, 2 * far]
    given = spark.createDataFrame([(t, v, float(v)) for t in steps for v in range(3)], "t long, var int, y double")
    pops = spark.createDataFrame(members, "pop_id int, var int")
    plan = spark.createDataFrame(schedule, "seg int, t_start long, t_end long, pop_id int")
    want = sorted((t, v, float(v) if (p, v) in members else None) for t in steps for v in range(3) for _, a, b, p in schedule if a <= t < b)
    key = lambda r: (r[0], r[1])
    for most in (100_000, 0):
        assert sorted((tuple(r) for r in panel.apply_scheme(given, pops, plan, most).collect()), key=key) == sorted(want, key=key)
    assert panel.apply_scheme(given, pops, plan.limit(0)).count() == 0


def test_every_step_of_long_spans(spark):
    got = lagcov.every(spark.createDataFrame([(0, 0, 25_000), (1, 7, 7), (2, -3, 12)], "trial int, a int, b int"), block=50)
    counts = {r.trial: (r.n, r.lo, r.hi, r.d) for r in got.groupBy("trial").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.countDistinct("t").alias("d")).collect()}
    assert counts == {0: (25_001, 0, 25_000, 25_001), 1: (1, 7, 7, 1), 2: (16, -3, 12, 16)}


def test_components_of_counts_are_found(spark):
    """One planted component behind twelve variables, a tenth of the cells unseen."""
    from tessera.jobs import count_factors

    rng = np.random.default_rng(3)
    x, c, d = rng.standard_normal(120), rng.standard_normal(12), rng.standard_normal(12) * 0.3 + 1.0
    y = rng.poisson(np.exp(np.outer(x, c) + d))
    rows = [(k // 40, 5 + k % 40, v, None if rng.random() < 0.1 else float(y[k, v])) for k in range(120) for v in range(12)]
    given = spark.createDataFrame(rows, "trial int, t int, var int, y double")
    loadings, factors, losses = count_factors.factored(given, 1, turns=3)
    assert all(b <= a for a, b in zip(losses, losses[1:], strict=False))
    got = {(r.trial, r.t): r.x[0] for r in factors.collect()}
    assert len(got) == 120 and abs(np.corrcoef([got[k // 40, 5 + k % 40] for k in range(120)], x)[0, 1]) > 0.95
    weights = {r["var"]: r["b"] for r in loadings.collect()}
    assert abs(np.corrcoef([weights[v][0] for v in range(12)], c)[0, 1]) > 0.95
    #: The loss is that of its definition.
    drive = np.array([[weights[v][0] * got[k // 40, 5 + k % 40] + weights[v][1] for v in range(12)] for k in range(120)])
    seen = np.array([r[3] is not None for r in rows]).reshape(120, 12)
    want = (np.exp(drive) - y * drive)[seen].sum() + 0.05 * (sum(v**2 for v in got.values()) + sum(w[0] ** 2 for w in weights.values()))
    assert np.isclose(losses[-1], want, rtol=1e-8)
    assert count_factors.factored(given.limit(0), 1)[2] == []
