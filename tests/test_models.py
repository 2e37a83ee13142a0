import numpy as np
import pytest

from tessera.jobs import fitting
from tessera.operators import kalman, lagcov, panel


def system(n=2, p=4, seed=3):
    rng = np.random.default_rng(seed)
    a = np.array([[0.9, 0.2], [-0.2, 0.8]])[:n, :n]
    return kalman.Model(a, 0.3 * np.eye(n), rng.standard_normal(n), np.eye(n), rng.standard_normal((p, n)), rng.standard_normal(p), 0.5 + rng.random(p))


def drawn(model, steps, seed):
    rng = np.random.default_rng(seed)
    x = rng.multivariate_normal(model.mu0, model.V0)
    out = []
    for _ in range(steps):
        out.append(model.C @ x + model.d + rng.standard_normal(len(model.d)) * np.sqrt(model.R))
        x = model.A @ x + rng.multivariate_normal(np.zeros(len(x)), model.Q)
    return np.array(out)


def joint(model, steps):
    """Mean and covariance of all states of a trial, stacked."""
    n = len(model.mu0)
    mean, cov = np.zeros(steps * n), np.zeros((steps * n, steps * n))
    m, v = model.mu0, model.V0
    for t in range(steps):
        s = slice(t * n, (t + 1) * n)
        mean[s], cov[s, s] = m, v
        c = v
        for u in range(t + 1, steps):
            c = model.A @ c
            r = slice(u * n, (u + 1) * n)
            cov[r, s], cov[s, r] = c, c.T
        m, v = model.A @ m, model.A @ v @ model.A.T + model.Q
    return mean, cov


def test_smoother_equals_dense_conditioning():
    model, steps = system(), 7
    y = drawn(model, steps, 1)
    y[2], y[4, 1:3] = np.nan, np.nan
    mean, cov = joint(model, steps)
    c = np.kron(np.eye(steps), model.C)
    on = np.isfinite(y.ravel())
    h, r = c[on], np.tile(model.R, steps)[on]
    s = h @ cov @ h.T + np.diag(r)
    e = y.ravel()[on] - np.tile(model.d, steps)[on] - h @ mean
    gain = cov @ h.T @ np.linalg.inv(s)
    want, left = mean + gain @ e, cov - gain @ h @ cov
    xs, vs, cross, ll = kalman.smoothed(model, y)
    assert np.allclose(xs.ravel(), want)
    assert np.allclose(vs[3], left[6:8, 6:8]) and np.allclose(cross[3], left[6:8, 4:6])
    assert np.isclose(ll, -0.5 * (e @ np.linalg.solve(s, e) + np.linalg.slogdet(s)[1] + len(e) * np.log(2 * np.pi)))


def test_em_never_lowers_the_likelihood(spark):
    model = system()
    rows = [(k, t, [None if (t + v) % 7 == 0 else float(x) for v, x in enumerate(row)]) for k in range(4) for t, row in enumerate(drawn(model, 30, k))]
    packed = spark.createDataFrame(rows, "trial int, t int, y array<double>")
    _, trace = fitting.fit(packed, fitting.start_model(2, np.zeros(4), np.ones(4)), rounds=6)
    assert len(trace) == 6 and all(b >= a - 1e-6 for a, b in zip(trace, trace[1:], strict=False))


def test_subspace_recovers_exact_covariances():
    model = system()
    pi = fitting.lyapunov(model.A, model.Q)
    q = np.array([model.C @ np.linalg.matrix_power(model.A, m) @ pi @ model.C.T + (np.diag(model.R) if m == 0 else 0) for m in range(4)])
    a, c, got, r = fitting.subspace(q, 2, 2)
    assert np.allclose(sorted(np.linalg.eigvals(a).imag), sorted(np.linalg.eigvals(model.A).imag), atol=1e-6)
    assert np.allclose(c @ got @ c.T, model.C @ pi @ model.C.T, atol=1e-6) and np.allclose(r, model.R, atol=1e-5)


@pytest.mark.parametrize("circular", [False, True])
def test_lag_cov_counts_observed_products(spark, circular):
    rng = np.random.default_rng(5)
    y = rng.standard_normal((2, 9, 3))
    y[rng.random(y.shape) < 0.2] = np.nan
    rows = [(k, t, v, float(y[k, t, v])) for k in range(2) for t in range(9) for v in range(3)]
    got = {(r["m"], r["i"], r["j"]): r["q"] for r in lagcov.lag_cov(spark.createDataFrame(rows, "trial int, t int, var int, y double"), 3, 3, circular=circular, length=9).collect()}
    z = y - np.nanmean(y.reshape(-1, 3), axis=0)
    for m, i, j in np.ndindex(3, 3, 3):
        a, b = (z[:, :, i], np.roll(z[:, :, j], m, axis=1)) if circular else (z[:, m:, i], z[:, : 9 - m, j])
        want = np.nansum(a * b) / (np.isfinite(z[:, :, i] * z[:, :, j]).sum() if circular else np.isfinite(a * b).sum())
        assert np.isclose(got[m, i, j], want)


def test_binning_keeps_silent_bins_and_drops_late_spikes(spark):
    rows = spark.createDataFrame([(0, 0, 0.2), (0, 0, 0.9), (0, 1, 2.0), (1, 0, 9.0), (1, 0, 1.0)], "trial int, var int, ts double")
    got = {(r["trial"], r["var"], r["t"]): r["y"] for r in panel.bin_spike_times(rows, 1.0, 3).collect()}
    assert len(got) == 12 and got[0, 0, 0] == 2 and got[0, 1, 2] == 1 and got[1, 0, 1] == 1 and sum(got.values()) == 4


def test_posterior_goes_through_steps_that_nobody_saw(spark):
    """Rows of t = 2..4 are missing altogether: the smoothed path equals dense conditioning on all seven steps."""
    model, steps = system(), 7
    y = drawn(model, steps, 5)
    cells = [(trial, t, i, float(y[t, i])) for trial in (1, 2) for t in range(steps) if not 2 <= t <= 4 for i in range(4) if trial == 1 or i != 3]
    panel_ = spark.createDataFrame([(a, b + 10, c, d) for a, b, c, d in cells], "trial int, t int, var int, y double")
    got = {(r.trial, r.t): r for r in kalman.posterior(lagcov.packed(panel_, 4, every_step=True), model).collect()}
    assert sorted(got) == [(k, t + 10) for k in (1, 2) for t in range(steps)]
    mean, cov = joint(model, steps)
    for trial in (1, 2):
        seen = [(t, i) for k, t, i, _ in cells if k == trial]
        h = np.zeros((len(seen), steps * 2))
        for row, (t, i) in enumerate(seen):
            h[row, 2 * t : 2 * t + 2] = model.C[i]
        e = np.array([y[t, i] - model.d[i] for t, i in seen]) - h @ mean
        gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + np.diag([model.R[i] for _, i in seen]))
        x, v = mean + gain @ e, cov - gain @ h @ cov
        for t in range(steps):
            s = slice(2 * t, 2 * t + 2)
            assert np.allclose(got[trial, t + 10].x, x[s]) and np.allclose(np.reshape(got[trial, t + 10].v, (2, 2)), v[s, s])


def test_prediction_slices_by_time(spark):
    from tessera.jobs import poisson

    model = kalman.Model(0.9 * np.eye(1), 0.1 * np.eye(1), np.zeros(1), np.eye(1), np.ones((2, 1)), np.zeros(2), np.ones(2))
    rows = [(0, t, i, float((t + i) % 3)) for t in (0, 1, 5, 6, 9) for i in range(2)]
    whole = spark.createDataFrame(rows + [(0, t, i, None) for t in (2, 3, 4, 7) for i in range(2)], "trial int, t int, var int, y double")
    got = [poisson.predict(lagcov.packed(p, 2, every_step=e), model, (0, 8), (8, 10)).orderBy("t", "var").collect() for p, e in ((whole, True), (whole.where("y IS NOT NULL"), False))]
    assert [(r.t, r.var) for r in got[0]] == [(8, 0), (8, 1), (9, 0), (9, 1)]
    assert np.allclose([r.rate for r in got[0]], [r.rate for r in got[1] if r.t >= 8])


def test_a_fit_goes_on_where_it_stopped(spark):
    from tessera.sources.store import shared_dir

    model = system(2, 3)
    rows = [(k, t, i, float(v)) for k in range(4) for t, row in enumerate(drawn(model, 30, k)) for i, v in enumerate(row)]
    packed = lagcov.packed(spark.createDataFrame(rows, "trial int, t int, var int, y double"), 3, every_step=True)
    start = fitting.start_model(2, np.zeros(3), np.ones(3))
    whole, trace = fitting.fit(packed, start, rounds=4)
    folder = shared_dir(spark)
    fitting.fit(packed, start, rounds=2, folder=folder)
    again, more = fitting.fit(packed, None, rounds=4, folder=folder)
    assert np.allclose(trace, more) and np.allclose(whole.C, again.C) and np.allclose(whole.mu0, again.mu0) and np.all(np.diff(trace) > -1e-9)
    batched, seen = fitting.online(packed, start, batches=2)
    assert sum(n for n, _ in seen) == 4 and np.isfinite(batched.C).all()


def test_smoother_of_one_series_is_the_vector_smoother(spark):
    rows = [(0, 0, t, None if t in (3, 4) else float(t % 4)) for t in range(9) if t != 6]
    given = spark.createDataFrame(rows, "trial int, var int, t int, y double")
    one = dict(a=0.8, q=0.3, c=1.5, d=0.1, r=0.7, mu0=0.2, v0=2.0)
    got = kalman.scalar_smoother(given, **one).orderBy("t").collect()
    y = np.full((9, 1), np.nan)
    for _, _, t, v in rows:
        y[t, 0] = np.nan if v is None else v
    m = kalman.Model(*[np.array([[one[k]]]) for k in "aq"], np.array([one["mu0"]]), np.array([[one["v0"]]]), np.array([[one["c"]]]), np.array([one["d"]]), np.array([one["r"]]))
    x, v, _, _ = kalman.smoothed(m, y)
    assert [r.t for r in got] == list(range(9)) and np.allclose([r.x for r in got], x[:, 0]) and np.allclose([r.v for r in got], v[:, 0, 0])
    assert [r.t for r in kalman.scalar_filter(given, **one).orderBy("t").collect()] == [0, 1, 2, 3, 4, 5, 7, 8]


def test_transformed_states_equal_matrix_products(spark):
    rng = np.random.default_rng(8)
    m, x, v = rng.standard_normal((2, 3)), rng.standard_normal(3), rng.standard_normal((3, 3))
    m = np.vstack([m, rng.standard_normal((1, 3))])
    r = kalman.transformed(spark.createDataFrame([(x.tolist(), v.ravel().tolist())], "x array<double>, v array<double>"), m).first()
    assert np.allclose(r.x, m @ x) and np.allclose(np.reshape(r.v, (3, 3)), m @ v @ m.T)
