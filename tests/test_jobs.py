import numpy as np
import pytest

from tessera.jobs import poisson, stitching
from tessera.operators import asof, graphs, panel, scheme
from tessera.operators.kalman import Model


def blocks(rng, steps, n):
    off = 0.3 * rng.standard_normal((steps - 1, n, n))
    diag = np.array([(a := rng.standard_normal((n, n))) @ a.T + 3 * np.eye(n) for _ in range(steps)])
    full = np.zeros((steps * n, steps * n))
    for t in range(steps):
        full[t * n : t * n + n, t * n : t * n + n] = diag[t]
        if t:
            full[t * n - n : t * n, t * n : t * n + n] = off[t - 1]
            full[t * n : t * n + n, t * n - n : t * n] = off[t - 1].T
    return diag, off, full


def test_block_solver_equals_the_dense_inverse():
    rng = np.random.default_rng(1)
    diag, off, full = blocks(rng, 6, 2)
    b = rng.standard_normal((6, 2))
    x, inv, up = poisson._solve_blocks(diag, off, b)
    dense = np.linalg.inv(full)
    assert np.allclose(x.ravel(), dense @ b.ravel())
    assert np.allclose(inv[2], dense[4:6, 4:6]) and np.allclose(up[2], dense[4:6, 6:8])
    assert np.isclose(sum(np.linalg.slogdet(p)[1] for p in poisson._pivots(diag, off)), np.linalg.slogdet(full)[1])


def model():
    rng = np.random.default_rng(2)
    return Model(np.array([[0.9, 0.1], [-0.1, 0.9]]), 0.1 * np.eye(2), np.array([0.5, -0.5]), np.eye(2), 0.7 * rng.standard_normal((6, 2)), np.full(6, 0.5), np.ones(6))


def test_laplace_mode_has_no_gradient():
    m = model()
    rng = np.random.default_rng(3)
    y = rng.poisson(2.0, (9, 6)).astype(float)
    y[3], y[5, 2] = np.nan, np.nan
    x, v, _, _ = poisson.laplace(m, y)
    diag, off, mean = poisson.prior_blocks(m, 9)
    rate = np.where(np.isfinite(y), np.exp(x @ m.C.T + m.d), 0)
    assert np.abs((np.where(np.isfinite(y), y, 0) - rate) @ m.C - poisson._times(diag, off, x - mean)).max() < 1e-4
    assert all(np.linalg.eigvalsh(a).min() > 0 for a in v)


def test_loading_gradient_equals_differences():
    m = model()
    rng = np.random.default_rng(4)
    y, x = rng.poisson(2.0, (7, 6)).astype(float), rng.standard_normal((7, 2))
    v = np.tile(0.2 * np.eye(2), (7, 1, 1))

    def value(c, d):
        h = x @ c.T + d
        return (y * h - np.exp(h + 0.5 * np.einsum("pi,tij,pj->tp", c, v, c))).sum(axis=0)

    got = poisson._loading_terms(m, y, x, v)["grad"]
    for k in range(2):
        e = np.zeros_like(m.C)
        e[:, k] = 1e-6
        assert np.allclose(got[:, k], (value(m.C + e, m.d) - value(m.C - e, m.d)) / 2e-6, rtol=1e-5, atol=1e-4)
    assert np.allclose(got[:, 2], (value(m.C, m.d + 1e-6) - value(m.C, m.d - 1e-6)) / 2e-6, rtol=1e-5, atol=1e-4)


def test_sampling_and_learning_counts(spark):
    trials = spark.range(6).selectExpr("CAST(id AS INT) AS trial")
    drawn = poisson.sample(trials, model(), 25, seed=9).toPandas()
    assert drawn.equals(poisson.sample(trials, model(), 25, seed=9).toPandas()) and len(drawn) == 6 * 25 * 6
    from tessera.operators import lagcov

    packed = lagcov.packed(spark.createDataFrame(drawn), 6)
    start = Model(0.8 * np.eye(2), 0.3 * np.eye(2), np.zeros(2), np.eye(2), 0.1 * np.random.default_rng(0).standard_normal((6, 2)), np.full(6, 0.5), np.ones(6))
    _, trace = poisson.fit(packed, start, rounds=5)
    assert trace[-1] > trace[0]
    ahead = poisson.predict(packed, model(), (0, 20), (20, 25))
    assert ahead.count() == 6 * 5 * 6 and ahead.where("rate <= 0").count() == 0


def test_stitching_fills_a_low_rank_system():
    m = model()
    from tessera.jobs.fitting import lyapunov

    pi = lyapunov(m.A, m.Q)
    q = np.array([m.C @ np.linalg.matrix_power(m.A, k) @ pi @ m.C.T + (np.diag(m.R) if k == 0 else 0) for k in range(4)])
    seen = np.ones(q.shape, bool)
    seen[:, 0, 5] = seen[:, 5, 0] = False
    full, trace = stitching.fill(np.where(seen, q, 0), seen, 2, 2, rounds=400)
    assert np.abs(full - q)[~seen].max() < 0.25 * np.abs(q[~seen]).max() and trace[-1] < trace[0]


def test_deterministic_realisation_and_completion():
    rng = np.random.default_rng(5)
    a, b, c = np.diag([0.9, -0.5]), rng.standard_normal((2, 2)), rng.standard_normal((3, 2))
    g = np.array([c @ np.linalg.matrix_power(a, t) @ b for t in range(6)])
    x, y, z = stitching.ho_kalman(g, 2, 3)
    assert np.allclose([z @ np.linalg.matrix_power(x, t) @ y for t in range(6)], g)
    t = stitching.align(c, a, z, x, 4)
    assert np.allclose(c @ t, z)
    low = np.outer(rng.standard_normal(6), rng.standard_normal(5))
    part = low.copy()
    part[1, 2] = part[4, 0] = np.nan
    assert np.allclose(stitching.soft_impute(part, 1, rounds=3000), low, atol=1e-4)


def test_as_of_takes_the_last_value_and_the_largest_of_ties(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (1, 7, "d")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 5, 10.0), (1, 5, 20.0), (1, 2, 1.0), (1, 8, 9.0)], "k int, t int, v double")
    got = {r["name"]: r["x"] for r in asof.as_of(left, right, ["k"], "t", "v", "x").collect()}
    assert got == {"a": 20.0, "b": None, "c": None, "d": 20.0}


def test_generations_and_cycles(spark):
    dep = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("a", "c", 0), ("c", "a", -1)], "parent string, child string, dt int")
    assert {r["node"]: r["generation"] for r in graphs.sampling_order(dep).collect()} == {"a": 0, "b": 1, "c": 2}
    assert graphs.own_ancestors(dep).count() == 0
    loop = dep.unionByName(spark.createDataFrame([("c", "b", 0)], dep.schema))
    assert {r["node"] for r in graphs.own_ancestors(loop).collect()} == {"b", "c"}


@pytest.mark.parametrize("most", [0, 10])
def test_schemes_mask_alike_by_interval_and_by_step(spark, most):
    cells = spark.createDataFrame([(t, v, 1.0) for t in range(6) for v in range(3)], "t int, var int, y double")
    pops = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "pop_id int, var int")
    times = spark.createDataFrame([(0, 0, 2, 0), (1, 2, 6, 1)], "seg int, t_start int, t_end int, pop_id int")
    got = {(r["t"], r["var"]): r["y"] for r in panel.apply_scheme(cells, pops, times, most).collect()}
    assert got == {(t, v): 1.0 if v == 1 or (v == 0) == (t < 2) else None for t in range(6) for v in range(3)}
    assert scheme.check(cells, pops, times).agg({"violations": "sum"}).first()[0] == 0
    bad = spark.createDataFrame([(0, 1, 2, 0), (1, 3, 5, 7)], times.schema)
    assert {r["rule"]: r["violations"] for r in scheme.check(cells, pops.where("var <> 2"), bad).collect()} == {"uncovered_variable": 1, "gap_in_time": 2, "empty_segment": 0, "unknown_population": 1, "wrong_end": 1}


def test_traversal_reaches_far_populations(spark):
    chain = spark.createDataFrame([(p, v) for p in range(12) for v in (p, p + 1)] + [(50, 99)], "pop_id int, var int")
    assert {r["pop_id"]: r["depth"] for r in scheme.traversal(chain).collect()} == {p: p for p in range(12)}


def test_chains_longer_than_64_steps_are_whole(spark):
    dep = spark.createDataFrame([(i, i + 1, 0) for i in range(69)] + [(200, 201, 0), (201, 200, 0), (201, 202, 0)], "parent long, child long, dt int")
    assert {r["node"]: r["generation"] for r in graphs.sampling_order(dep).collect()} == {i: i for i in range(70)}
    subpop = spark.createDataFrame([(p, v) for p in range(70) for v in (p, p + 1)], "pop_id int, var int")
    assert {r["pop_id"]: r["depth"] for r in scheme.traversal(subpop).collect()} == {i: i for i in range(70)}


def test_coobs_count_has_all_event_types(spark, tmp_path):
    from tessera.jobs.queries import coobs_count

    events = spark.sql("SELECT concat('type', id) AS event_type, 1.0D AS value, TIMESTAMP_NTZ '2024-01-02 03:00:00' AS ts FROM range(7)")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert {r["i"] for r in coobs_count(spark, str(tmp_path)).collect()} == set(range(7))
