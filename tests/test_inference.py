"""Variational and Laplace inference, link tables and predictions against definitions, differences and simulation-free bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import links
from tessera.jobs import poisson, variational
from tessera.operators import kalman
from tests.test_models import system
from tests.test_scan import panel_of


def counted(model, steps, seed):
    rng = np.random.default_rng(seed)
    x, out = rng.multivariate_normal(model.mu0, model.V0), []
    for _ in range(steps):
        out.append(rng.poisson(np.exp(np.minimum(model.C @ x + model.d, 4.0))).astype(float))
        x = model.A @ x + rng.multivariate_normal(np.zeros(len(x)), model.Q)
    return np.array(out)


def small(seed=3):
    m = system(2, 4, seed)
    return kalman.Model(m.A, m.Q, m.mu0, m.V0, 0.5 * m.C, 0.3 * m.d, 0.1 + 0 * m.R)


def test_dual_and_primal_bounds_meet():
    model = small()
    for seed in range(3):
        y = counted(model, 30, seed)
        y[4:7], y[10, 2] = np.nan, np.nan
        dual = variational.Dual(model, y)
        m, cov, cross, bound, gap = variational.infer(model, y)
        assert 0 <= gap + 1e-8 and gap < 1e-6
        #: The fixed point of the dual: its numbers are the expected rates.
        lam = np.exp((m @ model.C.T + model.d + 0.5 * np.einsum("pi,tij,pj->tp", model.C, cov, model.C))[dual.on])
        assert np.abs(dual(lam)[1]).max() < 1e-4
        for other in (lam * 1.3, np.full_like(lam, lam.mean()), lam + 0.1):
            assert dual(other)[0] >= bound - 1e-9 and dual.lower(other) <= bound + 1e-9


def test_gradient_of_the_dual_by_differences():
    model = small(5)
    dual = variational.Dual(model, counted(model, 8, 1))
    lam = 0.5 + np.random.default_rng(0).random(len(dual.y))
    _, g = dual(lam)
    for k in range(0, len(lam), 5):
        e = np.zeros_like(lam)
        e[k] = 1e-6
        assert np.isclose((dual(lam + e)[0] - dual(lam - e)[0]) / 2e-6, g[k], atol=1e-5)
    assert dual(-lam)[0] == np.inf


def test_variational_bound_is_above_that_of_the_laplace_posterior():
    model = small(7)
    y = counted(model, 25, 3)
    dual = variational.Dual(model, y)
    x, v, _, _ = poisson.laplace(model, y)
    rates = np.exp((x @ model.C.T + model.d)[dual.on])
    #: The posterior of these numbers has the Laplace mode's curvature; its mean is near the mode.
    assert variational.infer(model, y)[3] > dual.lower(rates) and variational.infer(model, y)[3] >= dual.lower(rates * np.exp(0.5 * np.einsum("ci,cij,cj->c", dual.loadings, v[dual.step], dual.loadings))) - 1e-9


def test_variational_posterior_over_trials(spark):
    model = small()
    trials = {k: counted(model, 12, k) for k in range(3)}
    trials[1][3] = np.nan
    got = variational.posterior(panel_of(spark, trials), model).collect()
    assert len(got) == 36 and max(abs(r.gap) for r in got) < 1e-6
    for k, y in trials.items():
        m, cov, _, bound, _ = variational.infer(model, y)
        own = sorted((r for r in got if r.trial == k), key=lambda r: r.t)
        assert np.allclose([r.x for r in own], m, atol=1e-6) and np.isclose(own[0].bound, bound)
    assert variational.posterior(panel_of(spark, trials).limit(0), model).count() == 0


@pytest.mark.parametrize("link", sorted(links.LINKS))
def test_modes_have_no_gradient(link):
    model = small(11)
    y = counted(model, 20, 2)
    y[5] = np.nan
    x, v, _, _ = poisson.laplace(model, y, link=link)
    diag, off, mean = poisson.prior_blocks(model, 20)
    on = np.isfinite(y)

    def height(z):
        h, e = z @ model.C.T + model.d, z - mean
        f = links.LINKS[link].rate(h)
        return np.where(on, np.where(on, y, 0) * np.log(f) - f, 0).sum() - 0.5 * (e * poisson._times(diag, off, e)).sum()

    for t, i in ((0, 0), (5, 1), (19, 1), (11, 0)):
        e = np.zeros_like(x)
        e[t, i] = 1e-5
        assert abs(height(x + e) - height(x - e)) / 2e-5 < 1e-3
        bend = (height(x + 100 * e) - 2 * height(x) + height(x - 100 * e)) / 1e-6
        assert bend < 0
    assert all(np.linalg.eigvalsh(c).min() > 0 for c in v)


def test_link_tables_and_lookups(spark):
    grid = links.Grid()
    values = links.table(spark, links.softplus).collect()
    assert len(values) == grid.size
    z, w = np.polynomial.hermite_e.hermegauss(80)
    for r in values[:: 37]:
        assert np.isclose(r.value, (w * np.logaddexp(0, r.m + r.s * z)).sum() / w.sum(), atol=1e-6)
    exact = {(r.i, r.k): r.value for r in values}
    rows = spark.createDataFrame([(-6.0, 0.0), (-5.9, 0.1), (0.1, 1.01), (5.99, 2.99), (6.0, 3.0), (99.0, 99.0), (-99.0, -1.0), (None, 1.0)], "m double, s double")
    for r in links.expected(rows, links.table(spark, links.softplus), "m", "s", "e").collect():
        if r.m is None:
            assert r.e is None
            continue
        x, y = min(max((r.m + 6) * 4, 0), 48), min(max(r.s * 4, 0), 12)
        i, k = min(int(x), 47), min(int(y), 11)
        want = sum(((1 - (x - i)) if a == 0 else x - i) * ((1 - (y - k)) if b == 0 else y - k) * exact[i + a, k + b] for a in (0, 1) for b in (0, 1))
        assert np.isclose(r.e, want)


def test_predictions_with_inputs_offsets_and_private_noise(spark):
    b = np.array([[0.7], [0.1]])
    m = small()
    model = kalman.Model(m.A, m.Q, m.mu0, m.V0, m.C, m.d, np.full(4, 0.3), b)
    y = counted(m, 9, 4)
    y[3] = np.nan
    u, s = np.linspace(-1, 1, 14)[:, None], np.outer(np.arange(14), [0.1, 0, -0.05, 0.02])
    put = lambda a, c: spark.createDataFrame([(0, t, row.tolist()) for t, row in enumerate(a)], f"trial int, t int, {c} array<double>")
    packed = panel_of(spark, {0: y})
    get = lambda **k: {(r.t, r.var): r.rate for r in poisson.predict(packed, model, (0, 9), (10, 14), **k).collect()}
    got = get(inputs=put(u, "u"), offsets=put(s, "s"))
    assert sorted(got) == [(t, i) for t in range(10, 14) for i in range(4)]
    x, v = poisson.at_end(model, y, u[:9], s[:9], False)
    for t in range(9, 14):
        x, v = model.A @ x + b @ u[t], model.A @ v @ model.A.T + model.Q
        for i in range(4):
            if t >= 10:
                assert np.isclose(got[t, i], np.exp(model.C[i] @ x + model.d[i] + s[t, i] + 0.5 * model.C[i] @ v @ model.C[i]))
    #: Without inputs, offsets and noise the state is the Laplace posterior's.
    x, v, _, _ = poisson.laplace(model, y)
    ends = poisson.at_end(model, y, np.zeros((9, 1)), np.zeros((9, 4)), False)
    assert np.allclose(ends[0], x[-1], atol=1e-4) and np.allclose(ends[1], v[-1], atol=1e-4)
    #: Noise that vanishes changes nothing; noise makes counts say less about the state.
    tiny = kalman.Model(m.A, m.Q, m.mu0, m.V0, m.C, m.d, np.full(4, 1e-9), b)
    near = poisson.at_end(tiny, y, np.zeros((9, 1)), np.zeros((9, 4)), True)
    assert np.allclose(near[0], ends[0], atol=1e-3)
    assert np.linalg.det(poisson.at_end(model, y, np.zeros((9, 1)), np.zeros((9, 4)), True)[1]) > np.linalg.det(ends[1])
    assert min(get(private=True).values()) > 0


def test_small_trials_are_dealt_to_all_tasks(spark):
    """Few bytes, long work: adaptive execution may not put all trials into one task."""
    model = kalman.Model(0.8 * np.eye(2), 0.36 * np.eye(2), np.zeros(2), np.eye(2), np.array([[0.2, 0.1], [0.1, -0.3]]), np.zeros(2), np.ones(2))
    rows = spark.createDataFrame([(k, t, [float((k + t) % 3), None if t % 4 == 0 else 1.0]) for k in range(16) for t in range(4)], "trial int, t int, y array<double>").repartition(3)
    for made in (variational.posterior(rows, model), poisson.posterior(rows, model), kalman.posterior(rows, model)):
        tasks = made.select("trial", "t", F.spark_partition_id().alias("task")).collect()
        assert len(tasks) == 64 and len({r.task for r in tasks}) >= 4
        assert all(len({r.task for r in tasks if r.trial == k}) == 1 for k in range(16))
