"""Steps of several lengths: moves against integrals, the smoother against dense conditioning, a fit that climbs to planted moves."""

import numpy as np
import pytest

from tests.conftest import SF
from tests.test_scan import panel_of
from tessera.jobs import timescales as ts
from tessera.operators import kalman, scan

M = np.array([[-0.9, 0.6, 0.0], [-0.6, -0.5, 0.1], [0.0, 0.0, -0.2]])
G = np.array([[1.0, 0.2, 0.0], [0.0, 0.7, 0.3], [0.1, 0.0, 0.5]])
GG = G @ G.T


def base(n=3, p=5, seed=0):
    rng = np.random.default_rng(seed)
    return kalman.Model(np.eye(n), np.eye(n), np.zeros(n), np.eye(n), rng.standard_normal((p, n)), rng.standard_normal(p), np.full(p, 0.3))


def test_moves_are_those_of_the_process():
    """Half steps compose, noise is its integral, and the stationary covariance is the same at every length."""
    w, v = np.linalg.eig(M)
    grid = np.linspace(0, 0.5, 4001)
    each = [ts.exponential(M * s) @ GG @ ts.exponential(M * s).T for s in grid]
    A, Q = ts.propagated(M, GG, 0.5)
    assert np.allclose(A, ((v * np.exp(w * 0.5)) @ np.linalg.inv(v)).real) and np.allclose(Q, np.trapezoid(each, grid, axis=0), atol=1e-6)
    half = ts.propagated(M, GG, 0.25)
    assert np.allclose(half[0] @ half[0], A) and np.allclose(half[0] @ half[1] @ half[0].T + half[1], Q)
    n = len(M)
    P = np.linalg.solve(np.kron(M, np.eye(n)) + np.kron(np.eye(n), M), -GG.ravel()).reshape(n, n)
    for dt in (0.02, 0.05, 0.5, 40.0):
        A, Q = ts.propagated(M, GG, dt)
        assert np.allclose(A @ P @ A.T + Q, P)


def schedule(spark, rows):
    return spark.createDataFrame(rows, "trial int, t int, scale int")


def test_lengths_are_found_as_of(spark):
    packed = panel_of(spark, {0: np.zeros((25, 1)), 1: np.zeros((4, 1)), 2: np.zeros((3, 1))})
    marks = schedule(spark, [(0, 3, 2), (0, 9, 0), (0, 9, 1), (0, 20, 0), (0, 90, 1), (1, -7, 1), (9, 0, 1), (1, 2, None)])
    for block in (4, 1000):
        got = {(r.trial, r.t): r.u for r in ts.scales(packed, marks, block=block).collect()}
        assert [got[0, t][0] for t in range(25)] == [2] * 9 + [1] * 11 + [0] * 5
        assert [got[1, t][0] for t in range(4)] == [1] * 4 and [got[2, t][0] for t in range(3)] == [0] * 3 and len(got) == 32


def dense(model, y, lengths):
    """Posterior means, covariances and the log-likelihood by conditioning one Gaussian of all steps."""
    n, steps = len(model.mu0), len(y)
    cov, move = np.zeros((steps * n, steps * n)), model.V0
    for t in range(steps):
        own = slice(t * n, t * n + n)
        if t:
            A, Q = model.moves[lengths[t]]
            cov[own, : t * n] = A @ cov[own.start - n : own.start, : t * n]
            cov[: t * n, own] = cov[own, : t * n].T
            move = A @ move @ A.T + Q
        cov[own, own] = move
    on = np.isfinite(y).ravel()
    C, d, R = np.kron(np.eye(steps), model.C)[on], np.tile(model.d, steps)[on], np.tile(model.R, steps)[on]
    S = C @ cov @ C.T + np.diag(R)
    e = y.ravel()[on] - d
    K = cov @ C.T @ np.linalg.inv(S)
    ll = -0.5 * (e @ np.linalg.solve(S, e) + np.linalg.slogdet(S)[1] + len(e) * np.log(2 * np.pi))
    after = cov - K @ C @ cov
    return (K @ e).reshape(steps, n), [after[t * n : t * n + n, t * n : t * n + n] for t in range(steps)], ll


@pytest.mark.parametrize("segment", [5, 100])
def test_smoother_is_dense_conditioning(spark, segment):
    model = ts.timed(base(), M, GG, [0.05, 0.5, 2.0])
    y = np.random.default_rng(1).standard_normal((24, 5))
    y[4:7], y[12, 1:3] = np.nan, np.nan
    lengths = [0] * 6 + [1] * 9 + [2] * 5 + [0] * 4
    got = sorted(ts.posterior(panel_of(spark, {0: y}), schedule(spark, [(0, 0, 0), (0, 6, 1), (0, 15, 2), (0, 20, 0)]), model, steps=segment).collect(), key=lambda r: r.t)
    xs, vs, ll = dense(model, y, lengths)
    assert np.allclose([r.x for r in got], xs, atol=1e-8) and np.allclose([np.reshape(r.v, (3, 3)) for r in got], vs, atol=1e-8)
    assert np.isclose(sum(r.loglik for r in got), ll)


def test_one_length_is_the_present_filter(spark):
    model = ts.timed(base(), M, GG, [0.5])
    plain = kalman.Model(model.A, model.Q, model.mu0, model.V0, model.C, model.d, model.R)
    packed = panel_of(spark, {0: np.random.default_rng(2).standard_normal((30, 5))})
    rows = lambda made: sorted((r.t, *r.x, *r.v, r.loglik) for r in made.collect())
    assert np.allclose(rows(ts.posterior(packed, schedule(spark, [(0, 0, 0)]), model, steps=8)), rows(scan.posterior(packed, plain, steps=8)))


def drawn(model, lengths, seed):
    rng, n = np.random.default_rng(seed), len(model.mu0)
    x, out = rng.standard_normal(n), []
    for t, k in enumerate(lengths):
        if t:
            A, Q = model.moves[k]
            x = A @ x + rng.multivariate_normal(np.zeros(n), Q)
        out.append(model.C @ x + model.d + rng.normal(0, np.sqrt(model.R)))
    return np.array(out)


def test_fit_finds_the_moves_of_each_length(spark):
    one = np.array([[1.0]])
    truth = ts.timed(kalman.Model(one, one, np.zeros(1), one, np.array([[1.0], [-0.8], [0.5]]), np.zeros(3), np.full(3, 0.05)), -0.4 * one, 0.8 * one, [0.25, 3.0])
    lengths = [0] * 300 + [1] * 300
    packed = panel_of(spark, {k: drawn(truth, lengths, k) for k in range(3)})
    marks = schedule(spark, [(k, t, s) for k in range(3) for t, s in ((0, 0), (300, 1))])
    start = ts.timed(ts._plain(truth), -0.1 * one, 0.3 * one, [0.25, 3.0])
    made, trace = ts.fit(packed, marks, start, rounds=12, segment=70)
    whole, same = ts.fit(packed, marks, start, rounds=2, segment=1000)
    assert np.allclose(trace[:2], same) and all(b > a for a, b in zip(trace, trace[1:], strict=False))
    assert abs(made.moves[0][0][0, 0] - np.exp(-0.1)) < 0.04 and abs(made.moves[1][0][0, 0] - np.exp(-1.2)) < 0.1
    assert ts.fit(packed.limit(0), marks, start)[1] == []
    with pytest.raises(ValueError, match="inputs"):
        ts.fit(packed, marks, ts.timed(base(), M, GG, [1.0]).__class__(**{**vars(start), "B": np.zeros((1, 2))}))


def test_query_climbs(spark):
    from tessera.jobs.state_queries import QUERIES

    trace = QUERIES["em_timescales"](spark, SF).toPandas().sort_values("round")["loglik"]
    assert len(trace) == 4 and trace.is_monotonic_increasing
