"""Inference by segments and learning with inputs and groups, against the serial recursion and against each other."""

import numpy as np
import pytest

from tessera.jobs import fitting, poisson
from tessera.operators import kalman, lagcov, scan, tasksums
from tests.test_models import drawn, system


def with_inputs(seed=3, n=2, p=4, m=2):
    model = system(n, p, seed)
    b = np.random.default_rng(seed + 1).standard_normal((n, m))
    return kalman.Model(model.A, model.Q, model.mu0, model.V0, model.C, model.d, model.R, b)


def panel_of(spark, trials):
    """Packed rows of trials [steps, p], NaN as null."""
    return spark.createDataFrame([(k, t, [None if np.isnan(x) else float(x) for x in row]) for k, y in trials.items() for t, row in enumerate(y)], "trial int, t int, y array<double>")


def serial(model, y, u):
    return kalman.smoothed_segment(model, y, u)


@pytest.mark.parametrize("segment", [1, 7, 40, 1000])
def test_segments_give_the_serial_smoother(spark, segment):
    model, rng = with_inputs(), np.random.default_rng(0)
    trials = {k: drawn(model, steps, k) for k, steps in ((0, 100), (1, 41), (2, 1), (3, 7))}
    trials[0][13:30], trials[1][5, 1:3] = np.nan, np.nan
    u = {k: rng.standard_normal((len(y), 2)) for k, y in trials.items()}
    inputs = spark.createDataFrame([(k, t, [float(x) for x in row]) for k, a in u.items() for t, row in enumerate(a)], "trial int, t int, u array<double>")
    got = {(r.trial, r.t): r for r in scan.posterior(panel_of(spark, trials), model, steps=segment, inputs=inputs).collect()}
    assert len(got) == 149
    for k, y in trials.items():
        xs, vs, cross, ll, _ = serial(model, y, u[k])
        for t in range(len(y)):
            r = got[k, t]
            assert np.allclose(r.x, xs[t], atol=1e-9) and np.allclose(r.v, vs[t].ravel(), atol=1e-9) and np.allclose(r.vv, cross[t].ravel(), atol=1e-9)
        assert np.isclose(sum(got[k, t].loglik for t in range(len(y))), ll, atol=1e-9)


def test_one_long_trial_is_shared_out(spark):
    """10,000 steps of one trial, as ten segments in several tasks."""
    model = system()
    y = drawn(model, 10_000, 1)
    packed = panel_of(spark, {0: y})
    rows = scan.chunks(packed, 1000)
    assert rows.count() == 10 and rows.select("seg").distinct().count() == 10
    got = sorted(scan.posterior(packed, model).collect(), key=lambda r: r.t)
    xs, vs, _, ll = kalman.smoothed(model, y)
    assert np.allclose([r.x for r in got], xs, atol=1e-9) and np.allclose([np.reshape(r.v, (2, 2)) for r in got], vs, atol=1e-9)
    assert np.isclose(sum(r.loglik for r in got), ll)


def brute_statistics(model, y, u):
    xs, vs, cross, ll, _ = serial(model, y, u)
    e = vs + xs[:, :, None] * xs[:, None, :]
    return {"ll": ll, "past": e[:-1].sum(0), "lag": (cross[1:] + xs[1:, :, None] * xs[:-1, None, :]).sum(0), "nu": xs[1:].T @ u[1:], "pu": xs[:-1].T @ u[1:], "uu": u[1:].T @ u[1:]}


def test_groups_and_segments_leave_the_fit_as_it_is(spark):
    """Variables of a group miss the same steps: one sum a group, cut into segments or not, gives the fit of one sum a variable."""
    model, rng = with_inputs(p=6), np.random.default_rng(2)
    groups = np.array([0, 0, 1, 1, 1, 2])
    trials, u = {}, {}
    for k in range(3):
        y, u[k] = drawn(model, 50, k), rng.standard_normal((50, 2))
        y[10:25, groups == 0], y[20:40, groups == 1] = np.nan, np.nan
        trials[k] = y
    packed = panel_of(spark, trials)
    inputs = spark.createDataFrame([(k, t, [float(x) for x in row]) for k, a in u.items() for t, row in enumerate(a)], "trial int, t int, u array<double>")
    sums = fitting.e_step(scan.chunks(packed, 13, inputs), model, groups)
    assert sums["xx"].shape == (3, 4)
    for name in ("ll", "past", "lag", "nu", "pu", "uu"):
        assert np.allclose(sums[name], sum(brute_statistics(model, trials[k], u[k])[name] for k in trials))
    first = fitting.start_model(2, np.zeros(6), np.ones(6))
    start = kalman.Model(*[getattr(first, f) for f in "A Q mu0 V0 C d R".split()], np.zeros((2, 2)))
    one, trace = fitting.fit(packed, start, 3, inputs=inputs)
    two, other = fitting.fit(packed, start, 3, inputs=inputs, groups=groups, segment=13)
    assert np.allclose(trace, other) and all(b >= a - 1e-6 for a, b in zip(trace, trace[1:], strict=False))
    assert all(np.allclose(getattr(one, f), getattr(two, f), atol=1e-7) for f in "A B Q mu0 V0 C d R".split())
    with pytest.raises(Exception, match="not seen together"):
        fitting.fit(packed, start, 1, inputs=inputs, groups=np.zeros(6, int))


def test_inputs_are_found_again(spark):
    """With inputs that drive the state the fit with B explains more than the one without."""
    model, rng = with_inputs(seed=5), np.random.default_rng(5)
    rows, u = [], []
    for k in range(6):
        x, ins = rng.multivariate_normal(model.mu0, model.V0), 2 * rng.standard_normal((60, 2))
        for t in range(60):
            x = x if t == 0 else model.A @ x + model.B @ ins[t] + rng.multivariate_normal(np.zeros(2), model.Q)
            rows.append((k, t, (model.C @ x + model.d + rng.standard_normal(4) * np.sqrt(model.R)).tolist()))
        u += [(k, t, ins[t].tolist()) for t in range(60)]
    packed, inputs = spark.createDataFrame(rows, "trial int, t int, y array<double>"), spark.createDataFrame(u, "trial int, t int, u array<double>")
    first = fitting.start_model(2, np.zeros(4), np.ones(4))
    start = kalman.Model(*[getattr(first, f) for f in "A Q mu0 V0 C d R".split()], np.zeros((2, 2)))
    made, trace = fitting.fit(packed, start, 25, inputs=inputs)
    _, plain = fitting.fit(packed, first, 25)
    assert trace[-1] > plain[-1] + 50
    #: What an input does to the observations doesn't depend on the latent coordinates.
    assert np.allclose(made.C @ made.B, model.C @ model.B, atol=0.35)


def test_empty_panels_and_panels_of_one_step(spark):
    start = fitting.start_model(2, np.zeros(3), np.ones(3))
    none = spark.createDataFrame([], "trial int, t int, y array<double>")
    model, trace = fitting.fit(none, start, 3)
    assert model is start and trace == [] and fitting.saved_rounds(none, start, 2).count() == 0 and scan.posterior(none, start).count() == 0
    assert fitting.online(none, start) == (start, []) and poisson.fit(none, start) == (start, [])
    single = panel_of(spark, {k: np.random.default_rng(k).standard_normal((1, 3)) for k in range(5)})
    model, trace = fitting.fit(single, start, 3)
    assert np.allclose(model.A, start.A) and np.allclose(model.Q, start.Q) and np.isfinite(model.C).all() and len(trace) >= 2


def test_sums_over_many_tasks(spark):
    rows = spark.range(300).repartition(150)
    got = tasksums.summed(rows, lambda b: [{"n": np.array([[b.num_rows]], float), "s": np.array([b.column(0).to_numpy().sum()], float)}], fan_in=16)
    assert got["n"][0, 0] == 300 and got["s"][0] == 300 * 299 / 2 and tasksums.summed(rows.limit(0), lambda b: []) == {}


def test_counts_fit_goes_on_and_keeps_the_better_model(spark):
    from tessera.sources.store import shared_dir

    rng = np.random.default_rng(1)
    rows = [(k, t, i, float(rng.poisson(1 + (t % 4 == i)))) for k in range(3) for t in range(15) for i in range(3)]
    packed = lagcov.packed(spark.createDataFrame(rows, "trial int, t int, var int, y double"), 3, every_step=True)
    start = fitting.start_model(1, np.zeros(3), np.full(3, 0.1))
    whole, trace = poisson.fit(packed, start, 4, gain=-1e9)
    folder = shared_dir(spark)
    poisson.fit(packed, start, 2, gain=-1e9, folder=folder)
    again, more = poisson.fit(packed, start, 4, gain=-1e9, folder=folder)
    assert np.allclose(trace, more) and np.allclose(whole.C, again.C) and trace[-1] > trace[0]


def test_segments_take_their_steps_at_once():
    """Maps and states of many segments from one pass over their steps, equal to those of each trial alone."""
    model, rng = system(2, 5, 4), np.random.default_rng(1)
    y = rng.standard_normal((40, 7, 5))
    y[rng.random(y.shape) < 0.4] = np.nan
    y[3, 2] = y[5] = np.nan
    moves = []

    class Counted(type(model)):
        def move(self, u):
            moves.append(1)
            return super().move(u)

    counted = Counted(**{f: getattr(model, f) for f in model.__dataclass_fields__})
    first = np.zeros(40, int)
    none = (np.zeros((40, 2)), np.tile(np.eye(2), (40, 1, 1)))
    found = scan.filtered_segments(counted, y, None, first, none)
    xs, vs, cross = scan.smoothed_segments(counted, None, first, none, (found[2][-1], found[3][-1]), found)
    total = scan.forward_maps(counted, y, None, first)
    assert len(moves) <= 3 * 7  # not 40 times that
    for k in range(40):
        want = kalman.smoothed(model, y[k])
        for a, b in zip((xs, vs, cross), want[:3], strict=True):
            assert np.allclose(a[:, k], b)
        assert np.isclose(found[4][:, k].sum(), want[3])
        assert np.allclose(total[1][k], found[2][-1, k]) and np.allclose(total[2][k], found[3][-1, k])
