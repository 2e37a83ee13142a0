"""More of the panel operators as queries: covariance variants, gaps in time, sums for learning, streams of states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.jobs import fitting
from tessera.jobs.queries import CENTERED, COUNTS, DEP, FILTER, GROUPS, HOURS, LINEAR, MASKED, ORACLES, QUERIES, SCALAR, SCHEME, SPIKES, VECTORS, _pops, _start, counts, dependencies, dims, kinds, linear, masked_counts, query
from tessera.operators import graphs, kalman, lagcov, learning, panel, scheme
from tessera.operators.panel import rounded
from tessera.sources import panels

__all__ = ["ORACLES", "QUERIES"]

EACH = SPIKES + """,
n AS (SELECT trial, var, CAST(floor(ts) AS INTEGER) AS t, count(*) AS y FROM sk GROUP BY ALL),
b AS (SELECT trial, CAST(ceil(max(ts)) AS INTEGER) AS bins FROM sk GROUP BY trial)"""


@query("bin_spike_times_each", f"WITH {EACH} SELECT b.trial, c.var, CAST(r.t AS INTEGER) AS t, CAST(coalesce(n.y, 0) AS BIGINT) AS y FROM b CROSS JOIN (SELECT DISTINCT var FROM n) c JOIN range(10000) r(t) ON r.t < bins LEFT JOIN n ON n.trial = b.trial AND n.var = c.var AND n.t = r.t")
def bin_spike_times_each(spark, sf):
    """Counts in which every trial ends with its own last spike: here the spikes of a day's first half."""
    return panel.bin_spike_times(panels.spikes(spark, sf), 1.0)


@query("traces_yobs", f"WITH {SCHEME} SELECT experiment, t, var, y FROM e JOIN sc ON t >= t_start AND t < t_end JOIN sp USING (pop_id, var) WHERE var % 7 = 3")
def traces_yobs(spark, sf):
    """Observed cells of every seventh variable under the scheme."""
    v = panels.vectors(spark, sf)
    seen = panel.apply_scheme(v, panels.subpops(v), panels.schedule(v)).where("y IS NOT NULL AND var % 7 = 3")
    return seen.select("experiment", "t", "var", "y")


@query("lag_cov_circ_full", f"""WITH {COUNTS}, z AS (SELECT trial, var, t, y - avg(y) OVER (PARTITION BY var) AS z FROM y)
SELECT CAST(m AS INTEGER) AS m, a.var AS i, b.var AS j, round(sum(a.z * b.z), 4) + 0.0 AS s, count(*) AS n FROM z a CROSS JOIN range(4) r(m) JOIN z b ON a.trial = b.trial AND b.t = (a.t - m + 24) % 24 GROUP BY ALL""")
def lag_cov_circ_full(spark, sf):
    return rounded(lagcov.lag_sums(counts(spark, sf), kinds(spark, sf), 4, length=HOURS), 4)


@query("lag_cov_window", f"""WITH {COUNTS}, z AS (SELECT trial, var, t, y - avg(y) OVER (PARTITION BY trial, var) AS z FROM y), h AS (SELECT trial, max(t) + 2 - 6 AS windows FROM y GROUP BY trial HAVING max(t) + 2 - 6 > 2)
SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, a.var AS i, b.var AS j, round(sum(a.z * b.z) / (SELECT sum(windows) FROM h), 6) + 0.0 AS q
FROM h JOIN z a USING (trial) CROSS JOIN range(3) x(r) CROSS JOIN range(3) w(c) JOIN z b ON b.trial = a.trial AND b.t = a.t - r - c - 1 WHERE a.t BETWEEN 3 + r AND 2 + r + windows GROUP BY ALL""")
def lag_cov_window(spark, sf):
    """Future and past blocks of three steps over all windows of the days."""
    return rounded(lagcov.window_cov(counts(spark, sf), kinds(spark, sf), 3))


@query("lag_cov_sample", f"""WITH {COUNTS}, l AS (SELECT trial, max(t) - 4 AS last FROM y GROUP BY trial)
SELECT CAST(m AS INTEGER) AS m, a.var AS i, b.var AS j, round(covar_samp(a.y, b.y), 6) + 0.0 AS q FROM y b JOIN l USING (trial) CROSS JOIN range(4) r(m) JOIN y a ON a.trial = b.trial AND a.t = b.t + m WHERE b.t <= last GROUP BY ALL""")
def lag_cov_sample(spark, sf):
    return rounded(lagcov.sample_cov(counts(spark, sf), kinds(spark, sf), 2, 2))


@query("io_hankel", f"""WITH {COUNTS}, b AS (SELECT trial, t, var, 'y' AS side, CAST(y AS DOUBLE) AS y FROM y UNION ALL SELECT DISTINCT trial, t, 0, 'u', CAST(t % 6 AS DOUBLE) FROM y), s AS (SELECT trial, max(t) - 4 AS last FROM y GROUP BY trial)
SELECT trial, CAST(t - 2 - lag AS INTEGER) AS row, side, CAST(lag AS INTEGER) AS lag, var, y FROM b JOIN s USING (trial) CROSS JOIN range(3) r(lag) WHERE t - 2 - lag BETWEEN 0 AND last""")
def io_hankel(spark, sf):
    """Rows of three steps of the hour within its quarter of a day and of all counts."""
    y = counts(spark, sf).withColumn("y", F.col("y").cast("double"))
    u = y.select("trial", "t", F.lit(0).alias("var"), (F.col("t") % 6).cast("double").alias("y")).distinct()
    return panel.io_windows(y, u, 3, 2)


@query("overlap_pairs", f"WITH {SCHEME} SELECT a.var AS i, b.var AS j FROM sp a JOIN sp b USING (pop_id) GROUP BY ALL HAVING count(*) > 1")
def overlap_pairs(spark, sf):
    return scheme.double_pairs(_pops(spark, sf))


@query("cross_overlap_pairs", f"WITH {GROUPS}, n AS (SELECT var, grp, count(*) > 1 AS several FROM sp JOIN ig USING (var) GROUP BY ALL) SELECT DISTINCT a.var AS i, b.var AS j FROM sp a JOIN sp b USING (pop_id) JOIN n x ON x.var = a.var JOIN n y ON y.var = b.var WHERE x.grp <> y.grp AND (x.several OR y.several)")
def cross_overlap_pairs(spark, sf):
    return scheme.cross_pairs(_pops(spark, sf))


@query("subgroup_tallies", f"WITH {GROUPS} SELECT (SELECT count(DISTINCT pop_id) FROM sp) AS n_pops, (SELECT count(DISTINCT grp) FROM ig) AS n_groups, (SELECT count(*) FROM ig) AS n_vars")
def subgroup_tallies(spark, sf):
    p = _pops(spark, sf)
    groups = scheme.index_groups(p).agg(F.countDistinct("grp").alias("n_groups"), F.count("*").alias("n_vars"))
    return p.agg(F.countDistinct("pop_id").alias("n_pops")).join(F.broadcast(groups))  # one row each


@query("dependency_check", f"""WITH {DEP}, d AS (SELECT * FROM dep UNION ALL SELECT 'view', 'view', 0)
SELECT 'acausal' AS rule, count(*) AS violations FROM d WHERE dt > 0 UNION ALL SELECT 'instant_self', count(*) FROM d WHERE dt = 0 AND parent = child
UNION ALL SELECT 'repeated', count(*) FROM (SELECT parent, child, dt FROM d GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'unknown', count(*) FROM d WHERE parent IS NULL OR child IS NULL OR dt IS NULL""")
def dependency_check(spark, sf):
    """What a dependency table may not hold, with one bad row put in: a type that depends on itself at once."""
    bad = spark.range(1).select(F.lit("view").alias("parent"), F.lit("view").alias("child"), F.lit(0).alias("dt"))
    return graphs.check(dependencies(spark, sf).unionByName(bad))


ACF = f"""{COUNTS}, z AS (SELECT trial, var, t, y - avg(y) OVER (PARTITION BY var) AS z FROM y),
s AS (SELECT a.var, m, sum(a.z * b.z) AS s FROM z a CROSS JOIN range(6) r(m) JOIN z b ON a.trial = b.trial AND a.var = b.var AND b.t = a.t - m GROUP BY ALL),
acf AS (SELECT var, m, s / s0 AS acf FROM s JOIN (SELECT var, s AS s0 FROM s WHERE m = 0) USING (var))"""


@query("acf_bounds", f"WITH {ACF}, e AS (SELECT var, 2 * sqrt((1 + 2 * sum(acf * acf) FILTER (m BETWEEN 1 AND 2)) / (SELECT count(*) FROM y WHERE y.var = acf.var)) AS edge FROM acf GROUP BY var) SELECT var, round(-edge, 6) AS lower, round(edge, 6) AS upper FROM e")
def acf_bounds(spark, sf):
    y = counts(spark, sf)
    return rounded(lagcov.acf_bounds(lagcov.autocorr(y, kinds(spark, sf), 6), y, 2))


GAP = FILTER.replace("k AS (SELECT trial, var, t, CASE WHEN (t + var) % 5 <> 0 THEN", "k AS (SELECT trial, var, t, CASE WHEN (t + var) % 5 <> 0 AND t NOT BETWEEN 8 AND 11 THEN")


def unseen(spark, sf):
    """Counts without any row for four hours of every day."""
    return masked_counts(spark, sf).where("t NOT BETWEEN 8 AND 11")


@query("kalman_filter_gap", f"WITH RECURSIVE {GAP} SELECT trial, var, t, round(mu, 6) + 0.0 AS mu, round(v, 6) AS v FROM fl")
def kalman_filter_gap(spark, sf):
    """A segment in which nothing is observed: the filter predicts through it."""
    return rounded(kalman.scalar_filter(unseen(spark, sf), every_step=True, **SCALAR))


@query("kalman_smoother_gap", f"""WITH RECURSIVE {GAP}, bk AS (
  SELECT trial, var, t, mu AS x, v FROM fl WHERE t = 23
  UNION ALL
  SELECT f.trial, f.var, f.t, f.mu + f.v * 0.9 / (0.81 * f.v + 0.5) * (b.x - 0.9 * f.mu), f.v + pow(f.v * 0.9 / (0.81 * f.v + 0.5), 2) * (b.v - (0.81 * f.v + 0.5))
  FROM bk b JOIN fl f ON f.trial = b.trial AND f.var = b.var AND f.t = b.t - 1)
SELECT trial, var, t, round(x, 6) + 0.0 AS x, round(v, 6) AS v FROM bk""")
def kalman_smoother_gap(spark, sf):
    return rounded(kalman.scalar_smoother(unseen(spark, sf), **SCALAR))


@query("kalman_smoother_gap_vector")
def kalman_smoother_gap_vector(spark, sf):
    """Two latent dimensions over all event types, through the same gap."""
    _, model = _start(spark, sf)
    return kalman.posterior(lagcov.packed(unseen(spark, sf), kinds(spark, sf), every_step=True), model)


@query("posterior_transformed", f"""WITH RECURSIVE {FILTER}, p AS (SELECT a.trial, a.t, a.mu AS a, b.mu AS b, a.v AS va, b.v AS vb FROM fl a JOIN fl b ON a.trial = b.trial AND a.t = b.t AND a.var = 0 AND b.var = 1)
SELECT trial, t, round(2 * a + b, 6) + 0.0 AS x0, round(-a + 0.5 * b, 6) + 0.0 AS x1, round(4 * va + vb, 6) AS v00, round(-2 * va + 0.5 * vb, 6) AS v01, round(va + 0.25 * vb, 6) AS v11 FROM p""")
def posterior_transformed(spark, sf):
    """States of two series in other coordinates."""
    one = kalman.scalar_filter(masked_counts(spark, sf), **SCALAR).where("var < 2")
    at = lambda c, k: F.max(F.when(F.col("var") == k, F.col(c)))
    both = one.groupBy("trial", "t").agg(F.array(at("mu", 0), at("mu", 1)).alias("x"), F.array(at("v", 0), F.lit(0.0), F.lit(0.0), at("v", 1)).alias("v"))
    made = kalman.transformed(both, np.array([[2.0, 1.0], [-1.0, 0.5]]))
    return rounded(made.select("trial", "t", F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1"), *[F.get("v", F.lit(k)).alias(n) for k, n in ((0, "v00"), (1, "v01"), (3, "v11"))]))


#: States of the learning sums: the filtered levels of series 0 and 1; input: the hour.
LEARN = FILTER + """,
g AS (SELECT DISTINCT var, var // 2 AS grp FROM k),
ft AS (SELECT trial, t, 'x' || var AS f, mu AS z, v FROM fl WHERE var < 2 UNION ALL SELECT DISTINCT trial, t, 'u0', t / 7.0::DOUBLE, 0.0::DOUBLE FROM fl UNION ALL SELECT DISTINCT trial, t, '1', 1.0::DOUBLE, 0.0::DOUBLE FROM fl),
sq AS (SELECT a.trial, a.t, a.f, b.f AS g, a.z * b.z + CASE WHEN a.f = b.f THEN a.v ELSE 0 END AS zz FROM ft a JOIN ft b USING (trial, t))"""


def _latent(spark, sf):
    fl = kalman.scalar_filter(masked_counts(spark, sf), **SCALAR).where("var < 2")
    states = fl.select("trial", "t", F.col("var").alias("k"), F.col("mu").alias("x"))
    inputs = states.select("trial", "t").distinct().select("trial", "t", F.lit(0).alias("k"), (F.col("t") / 7.0).alias("u"))
    return learning.regressors(states, inputs), fl.select("trial", "t", F.col("var").alias("k"), F.col("var").alias("l"), "v")


@query("em_suffstats_groups", f"WITH RECURSIVE {LEARN} SELECT grp, f, sq.g, round(sum(zz), 4) + 0.0 AS s, count(*) AS n FROM sq JOIN (SELECT DISTINCT grp, trial, t FROM k JOIN g USING (var) WHERE y IS NOT NULL) USING (trial, t) GROUP BY ALL")
def em_suffstats_groups(spark, sf):
    """Moments of states, inputs and offset by group of variables, over the steps at which the group is seen."""
    features, covs = _latent(spark, sf)
    y = masked_counts(spark, sf)
    groups = y.select("var").distinct().select("var", F.floor(F.col("var") / 2).cast("int").alias("grp"))
    return rounded(learning.group_moments(y, groups, features, covs), 4)


@query("mstep_obs_stats", f"WITH RECURSIVE {LEARN} SELECT var, f, round(sum(y * z), 4) + 0.0 AS yz, round(sum(y * y), 4) AS yy, count(*) AS n FROM k JOIN ft USING (trial, t) WHERE y IS NOT NULL GROUP BY ALL")
def mstep_obs_stats(spark, sf):
    features, _ = _latent(spark, sf)
    return rounded(learning.observation_moments(masked_counts(spark, sf), features), 4)


@query("mstep_dynamics_stats", f"""WITH RECURSIVE {LEARN}, nx AS (SELECT trial, t - 1 AS t, f AS k, z AS x FROM ft WHERE f LIKE 'x%' AND t > 0)
SELECT 'past' AS side, f AS a, g AS b, round(sum(zz), 4) + 0.0 AS s FROM sq WHERE t < 23 GROUP BY ALL UNION ALL SELECT 'next', k, f, round(sum(x * z), 4) + 0.0 FROM nx JOIN ft USING (trial, t) GROUP BY ALL""")
def mstep_dynamics_stats(spark, sf):
    """Sums of the dynamics' regression, with inputs; filtered states have no covariance between steps."""
    features, covs = _latent(spark, sf)
    past, after = learning.dynamics_moments(features, covs, covs.limit(0))
    rows = past.select(F.lit("past").alias("side"), F.col("f").alias("a"), F.col("g").alias("b"), "s")
    return rounded(rows.unionByName(after.select(F.lit("next").alias("side"), F.col("k").alias("a"), F.col("f").alias("b"), "s")), 4)


#: A model of two independent latent series whose loadings are each variable's mean and deviation.
MODEL = VECTORS + """,
c AS (SELECT var, unnest([0, 1]) AS k, unnest([a, b]) AS w FROM (SELECT var, avg(y) AS a, stddev_pop(y) AS b FROM e GROUP BY var)),
am AS (SELECT CAST(m AS INTEGER) AS m, k, k AS l, pow(CASE k WHEN 0 THEN 0.9 ELSE 0.5 END, m) AS w FROM range(3) r(m), (SELECT unnest([0, 1]) AS k)),
mq AS (SELECT m, i, j, s + CASE WHEN m = 0 AND i = j THEN 0.01 ELSE 0 END AS q FROM (SELECT m, a.var AS i, b.var AS j, sum(a.w * am.w * b.w) AS s FROM am JOIN c a ON a.k = am.k JOIN c b ON b.k = am.l GROUP BY ALL))"""
MEASURED = MODEL + """, z AS (SELECT t, var, y - avg(y) OVER (PARTITION BY var) AS z FROM e),
q AS (SELECT CAST(m AS INTEGER) AS m, a.var AS i, b.var AS j, avg(a.z * b.z) AS q FROM z a CROSS JOIN range(3) r(m) JOIN z b ON b.t = a.t - m GROUP BY ALL),
r AS (SELECT m, i, j, mq.q - q.q AS e FROM q JOIN mq USING (m, i, j) WHERE abs(i - j) < 16)"""


def _model(spark, sf):
    v = panels.vectors(spark, sf)
    level = v.groupBy("var").agg(F.avg("y").alias("a"), F.stddev_pop("y").alias("b"))
    loadings = level.select("var", F.posexplode(F.array("a", "b")).alias("k", "w"))
    inner = spark.range(3).select(F.col("id").cast("int").alias("m"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    inner = inner.select("m", "k", F.col("k").alias("l"), F.pow(F.when(F.col("k") == 0, 0.9).otherwise(F.lit(0.5)), F.col("m")).alias("w"))
    return loadings, inner, lagcov.model_cov(loadings, inner, level.select("var", F.lit(0.01).alias("r")))


@query("model_lagcov", f"WITH {MODEL} SELECT m, i, j, round(q, 6) + 0.0 AS q FROM mq")
def model_lagcov(spark, sf):
    return rounded(_model(spark, sf)[2])


def _measured(spark, sf):
    v = panels.vectors(spark, sf).select(F.lit(0).alias("trial"), "t", "var", "y")
    q = lagcov.lag_cov(v, dims(spark, sf), 3)
    return q, q.where("abs(i - j) < 16").select("i", "j").distinct()


@query("hankel_loss_model", f"WITH {MEASURED} SELECT m, round(avg(e * e) / 2, 8) AS loss, count(*) AS n FROM r GROUP BY m")
def hankel_loss_model(spark, sf):
    """Loss of the model's covariances over pairs of near variables, as if only those had been seen together."""
    q, mask = _measured(spark, sf)
    return rounded(lagcov.hankel_loss(q, _model(spark, sf)[2], mask), 8)


@query("hankel_grads", f"""WITH {MEASURED}, g AS (SELECT r.i AS var, am.k, e * am.w * c.w AS g FROM r JOIN am USING (m) JOIN c ON c.var = r.j AND c.k = am.l UNION ALL SELECT r.j, am.l, e * am.w * c.w FROM r JOIN am USING (m) JOIN c ON c.var = r.i AND c.k = am.k)
SELECT var, CAST(k AS INTEGER) AS k, round(sum(g), 6) + 0.0 AS g FROM g GROUP BY ALL""")
def hankel_grads(spark, sf):
    q, mask = _measured(spark, sf)
    loadings, inner, model = _model(spark, sf)
    return rounded(lagcov.loading_gradient(q, model, mask, loadings, inner))


@query("online_em")
def online_em(spark, sf):
    """Log-likelihood a day and its share of days by batch of expectation maximisation with blended sums."""
    rows, model = _start(spark, sf)
    _, trace = fitting.online(rows, model, batches=4)
    return spark.createDataFrame([(k, n, float(x)) for k, (n, x) in enumerate(trace)], "batch int, trials int, loglik double")


@query("em_parameters")
def em_parameters(spark, sf):
    """The parameters of every round of expectation maximisation, as the table from which a fit goes on."""
    rows, model = _start(spark, sf)
    return fitting.saved_rounds(rows, model, rounds=3)
