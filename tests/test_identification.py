"""Partial models along the tree of overlaps, stochastic descent on lagged products, canonical forms."""

import numpy as np
import pytest

from tessera.jobs import fitting, hankel_descent, partial_models
from tessera.operators import kalman, lagcov, scan, scheme
from tests.test_models import drawn, system
from tests.test_scan import panel_of


def exact(p, lags, seed=3):
    """Lag covariances of a system with two states, and the system."""
    model = system(2, p, seed)
    pi = fitting.lyapunov(model.A, model.Q)
    q = np.array([model.C @ np.linalg.matrix_power(model.A, m) @ pi @ model.C.T + (np.diag(model.R) if m == 0 else 0) for m in range(lags)])
    return model, q


def test_covariances_of_pairs_that_were_never_seen_together(spark):
    """Four populations in a chain, each sharing three variables with the next; nothing of pairs across is given."""
    pops = {0: range(0, 6), 1: range(3, 9), 2: range(6, 12), 3: range(9, 15)}
    model, q = exact(15, 6)
    given = {(m, i, j): q[m, i, j] for m in range(6) for own in pops.values() for i in own for j in own}
    table = spark.createDataFrame([(*k, float(v)) for k, v in given.items()], "m int, i int, j int, q double")
    subpop = spark.createDataFrame([(k, v) for k, own in pops.items() for v in own], "pop_id int, var int")
    tree = scheme.tree(subpop, 0)
    assert sorted((r.pop_id, r.parent, r.place) for r in tree.collect()) == [(0, None, 0), (1, 0, 1), (2, 1, 2), (3, 2, 3)]
    loadings, inner, noise = partial_models.stitched(table, subpop, tree, 2, 3)
    made = {(r.m, r.i, r.j): r.q for r in lagcov.model_cov(loadings, inner, noise).collect()}
    assert len(made) == 6 * 15 * 15 and len(given) < len(made)
    assert all(np.isclose(made[m, i, j], q[m, i, j], atol=1e-5) for m, i, j in np.ndindex(q.shape))


def test_trees_are_walked_in_depth_first_order(spark):
    """Parents as a recursion claims them: all open neighbours of a node at once, then each one's subtree in order."""
    rng = np.random.default_rng(4)
    for _ in range(4):
        pops = {k: set(rng.choice(14, 3, replace=False).tolist()) for k in range(9)}
        open_, out = set(pops) - {0}, [(0, None)]

        def visit(i):
            js = [j for j in sorted(open_) if pops[i] & pops[j]]
            open_.difference_update(js)
            out.extend((j, i) for j in js)
            for j in js:
                visit(j)

        visit(0)
        table = spark.createDataFrame([(k, int(v)) for k, own in pops.items() for v in own], "pop_id int, var int")
        got = sorted(scheme.tree(table, 0).collect(), key=lambda r: r.place)
        assert [(r.pop_id, r.parent) for r in got] == out
    assert scheme.tree(table.limit(0), 0).count() == 0


def test_gradients_of_lagged_products_by_differences():
    rng = np.random.default_rng(0)
    s = hankel_descent.System(rng.standard_normal((4, 2)), rng.standard_normal((2, 2, 2)), rng.random(4))
    now, before = rng.standard_normal((6, 4)), rng.standard_normal((6, 4))
    now[rng.random(now.shape) < 0.3], before[rng.random(before.shape) < 0.3] = np.nan, np.nan
    for m, past in ((0, now), (1, before)):

        def loss(s, m=m, past=past):
            e = s.C @ s.X[m] @ s.C.T + (np.diag(s.R) if m == 0 else 0) - now[:, :, None] * past[:, None, :]
            return 0.5 * np.nansum(e**2)

        got = hankel_descent.gradients(s, m, now, past)
        assert np.isclose(got["loss"][m], loss(s))
        for name, key in (("C", f"C{m}"), ("X", "X"), ("R", f"R{m}")):
            own = getattr(s, name)
            for at in np.ndindex(own.shape):
                keep, ends = own[at], []
                for h in (1e-5, -1e-5):
                    own[at] = keep + h
                    ends.append(loss(s))
                own[at] = keep
                assert np.isclose((ends[0] - ends[1]) / 2e-5, got[key][at], atol=1e-4, rtol=1e-5)


@pytest.fixture(scope="module")
def measured(spark):
    model = system(2, 5)
    y = {k: drawn(model, 300, k) for k in range(3)}
    rows = [(k, t, v, float(x)) for k, a in y.items() for (t, v), x in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "trial int, t int, var int, y double")


def test_descent_reaches_the_loss_of_subspaces(spark, measured):
    from tessera.sources.store import shared_dir

    rows = hankel_descent.pairs(measured, 5, 4)
    start = hankel_descent.started(5, 2, 4, scale=2.0)
    s, trace = hankel_descent.fit(rows, start, rounds=150, batches=1, rate=0.1, decay=0.7)
    q = fitting.dense(lagcov.lag_cov(measured, 5, 4), 4, 5)
    a, c, pi, r = fitting.subspace(q, 2, 2)
    far = lambda m, own: (((own + (np.diag(n) if m == 0 else 0)) - q[m]) ** 2).mean()
    n = s.R
    mine = sum(far(m, s.C @ s.X[m] @ s.C.T) for m in range(4))
    n = r
    theirs = sum(far(m, c @ np.linalg.matrix_power(a, m) @ pi @ c.T) for m in range(4))
    assert trace[-1] < trace[0] and mine <= theirs * 1.05 + 1e-3
    #: Batches, and a run in two parts.
    folder = shared_dir(spark)
    whole, losses = hankel_descent.fit(rows, start, rounds=6, batches=3)
    hankel_descent.fit(rows, start, rounds=3, batches=3, folder=folder)
    assert len(losses) == 6 and np.isfinite(whole.C).all()
    again, more = hankel_descent.fit(rows, start, rounds=5, batches=3, folder=folder)
    assert len(more) == 5
    none, nothing = hankel_descent.fit(rows.limit(0), start, rounds=2)
    assert nothing == [] and np.allclose(none.C, start.C)


@pytest.mark.parametrize("kind", ["orthonormal", "unit_states", "unit_loadings"])
def test_canonical_forms_leave_the_likelihood(spark, kind):
    model = system(2, 6)
    y = drawn(model, 30, 2)
    m, made = fitting.canonical(model, kind)
    pi = fitting.lyapunov(made.A, made.Q)
    if kind == "orthonormal":
        assert np.allclose(made.C.T @ made.C, np.eye(2)) and np.allclose(pi, np.diag(np.diag(pi)), atol=1e-8)
    if kind == "unit_states":
        assert np.allclose(pi, np.eye(2), atol=1e-8) and np.allclose(made.C.T @ made.C, np.diag(np.diag(made.C.T @ made.C)), atol=1e-8)
    if kind == "unit_loadings":
        assert np.allclose((made.C**2).sum(0), 1)
    assert np.isclose(kalman.smoothed(model, y)[3], kalman.smoothed(made, y)[3])
    packed = panel_of(spark, {0: y})
    want = {r.t: r for r in scan.posterior(packed, made).collect()}
    for r in kalman.transformed(scan.posterior(packed, model), m, "vv").collect():
        assert np.allclose(r.x, want[r.t].x) and np.allclose(r.v, want[r.t].v) and np.allclose(r.vv, want[r.t].vv)
