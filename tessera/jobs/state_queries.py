"""State-space learning as queries: inputs, groups, long trials, variational inference, regressions; one latent dimension has SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import links
from tessera.jobs import count_factors, fitting, hankel_descent, low_rank_rates, partial_models, poisson, timescales, variational
from tessera.jobs.learning_queries import ORACLES, QUERIES
from tessera.jobs.queries import COUNTS, MASKED, SCHEME, VECTORS, _poisson_start, _pops, _start, counts, dims, kinds, masked_counts, query
from tessera.operators import kalman, lagcov, learning, scan, scheme
from tessera.operators.panel import rounded
from tessera.sources import panels

__all__ = ["ORACLES", "QUERIES"]


def _infer_sql(k: int) -> str:
    """Filter f, backward pass bk and smoothed rows sm of round k from sums of seen cells i and parameters par (one row)."""
    return f"""f{k} AS (
  SELECT i.trial, i.t, mu0 AS m, v0 AS p, mu0 + (w - s * mu0) / (1 / v0 + s) AS mu, 1 / (1 / v0 + s) AS v FROM i{k} i, par{k} WHERE t = 0
  UNION ALL
  SELECT i.trial, i.t, a * mu + b * u, a * a * v + q, a * mu + b * u + (w - s * (a * mu + b * u)) / (1 / (a * a * v + q) + s), 1 / (1 / (a * a * v + q) + s)
  FROM f{k} f JOIN i{k} i ON i.trial = f.trial AND i.t = f.t + 1, par{k}),
g{k} AS MATERIALIZED (SELECT * FROM f{k}),
bk{k} AS (
  SELECT trial, t, mu AS x, v AS vs FROM g{k} WHERE t = (SELECT max(t) FROM g{k})
  UNION ALL
  SELECT f.trial, f.t, f.mu + f.v * a / n.p * (bk.x - n.m), f.v + pow(f.v * a / n.p, 2) * (bk.vs - n.p)
  FROM bk{k} bk JOIN g{k} n ON n.trial = bk.trial AND n.t = bk.t JOIN g{k} f ON f.trial = bk.trial AND f.t = bk.t - 1, par{k}),
sb{k} AS MATERIALIZED (SELECT * FROM bk{k}),
sm{k} AS MATERIALIZED (SELECT s.trial, s.t, s.x, s.vs, p.x AS xp, p.vs AS vp, e.v * a / f.p * s.vs AS cr
  FROM sb{k} s JOIN g{k} f USING (trial, t) LEFT JOIN sb{k} p ON p.trial = s.trial AND p.t = s.t - 1 LEFT JOIN g{k} e ON e.trial = s.trial AND e.t = s.t - 1, par{k})"""


#: A day's hours, what was seen in them, an input, and the first parameters.
_EM_START = MASKED + """,
o AS MATERIALIZED (SELECT trial, t, var, y FROM k WHERE y IS NOT NULL),
st AS MATERIALIZED (SELECT DISTINCT trial, t, ((t + trial) % 6) / 6.0::DOUBLE AS u FROM k),
par0 AS (SELECT 0.8::DOUBLE AS a, 0.36::DOUBLE AS q, 0.0::DOUBLE AS b, 0.0::DOUBLE AS mu0, 1.0::DOUBLE AS v0),
obs0 AS MATERIALIZED (SELECT var, sqrt(greatest(var_pop(y), 1e-6) / 2) AS c, avg(y) AS d, greatest(var_pop(y), 1e-6) / 2 AS r FROM o GROUP BY var)"""


def _em_sql(rounds: int, *, inputs: bool, batches: int = 0, blend: float = 0.6) -> str:
    """Rounds of expectation maximisation for one latent dimension; with batches each round sees the trials of one, and sums are blended."""
    parts = [_EM_START]
    for k in range(rounds):
        own = f"WHERE st.trial % {batches} = {k}" if batches else ""
        w = 1.0 if not batches or k == 0 else (k + 1) ** -blend
        share = f"/ (SELECT count(*) FROM i{k} WHERE t = 0)" if batches else ""
        mixed = lambda new, old: f"{w!r} * ({new}) {share}" + (f" + {1 - w!r} * {old}" if w < 1 else "")
        names = {"past": "sum(vp + xp * xp)", "nxt": "sum(vs + x * x) FILTER (t > 0)", "lg": "sum(cr + x * xp)", "nu": "sum(x * u) FILTER (t > 0)", "pu": "sum(xp * u)", "uu": "sum(u * u) FILTER (t > 0)", "steps": "count(xp)", "trials": "count(*) FILTER (t = 0)", "x0": "sum(x) FILTER (t = 0)", "e0": "sum(vs + x * x) FILTER (t = 0)"}
        sums = {"n": "count(*)", "sy": "sum(y)", "syy": "sum(y * y)", "syx": "sum(y * x)", "sx": "sum(x)", "sxx": "sum(x * x + vs)"}
        parts.append(f"""i{k} AS MATERIALIZED (
  SELECT st.trial, st.t, st.u, coalesce(sum(c * c / r), 0) AS s, coalesce(sum(c * (y - d) / r), 0) AS w, coalesce(sum((y - d) * (y - d) / r), 0) AS quad, coalesce(sum(ln(r)), 0) AS logr, count(y) AS n
  FROM st LEFT JOIN (SELECT * FROM o JOIN obs{k} USING (var)) o ON o.trial = st.trial AND o.t = st.t {own} GROUP BY ALL)""")
        parts.append(_infer_sql(k))
        parts.append(f"ll{k} AS (SELECT sum(-0.5 * (quad - 2 * m * w + s * m * m - (w - s * m) * (w - s * m) * v + logr + ln(1 + s * p) + n * ln(2 * pi()))) AS ll, count(*) FILTER (t = 0) AS trials FROM i{k} JOIN g{k} USING (trial, t))")
        old = lambda n: f"(SELECT {n} FROM h{k - 1})"
        parts.append(f"h{k} AS MATERIALIZED (SELECT {', '.join(f'{mixed(e, old(n))} AS {n}' for n, e in names.items())} FROM sm{k} JOIN st USING (trial, t))")
        before = lambda n: f"any_value(b.{n})"
        parts.append(f"v{k} AS MATERIALIZED (SELECT var, {', '.join(f'{mixed(e, before(n))} AS {n}' for n, e in sums.items())} FROM (SELECT var, y, x, vs FROM o JOIN sm{k} USING (trial, t)) z {f'JOIN v{k - 1} b USING (var)' if batches and k else ''} GROUP BY var)")
        ab = "(lg * uu - nu * pu) / (past * uu - pu * pu) AS a, (nu * past - lg * pu) / (past * uu - pu * pu) AS b" if inputs else "lg / past AS a, 0.0::DOUBLE AS b"
        parts.append(f"""par{k + 1} AS MATERIALIZED (SELECT a, (nxt - 2 * (a * lg + b * nu) + a * a * past + 2 * a * b * pu + b * b * uu) / steps + 1e-12 AS q, b, mu0, e0 - mu0 * mu0 + 1e-9 AS v0
  FROM (SELECT *, {ab} FROM (SELECT past, nxt, lg, nu, pu, uu, steps, x0 / trials AS mu0, e0 / trials AS e0 FROM h{k})))""")
        parts.append(f"""obs{k + 1} AS MATERIALIZED (SELECT var, c, d, greatest(1e-6, (syy - 2 * d * sy - 2 * c * syx + c * c * sxx + 2 * d * c * sx) / n + d * d) AS r
  FROM (SELECT *, (sy - c * sx) / n AS d FROM (SELECT *, (syx - sy * sx / n) / (sxx - sx * sx / n) AS c FROM v{k})))""")
    return ",\n".join(parts)


def _table_sql(rounds: int, inputs: bool) -> str:
    out = []
    for k in range(1, rounds + 1):
        scalars = [("A", "a"), ("Q", "q"), ("mu0", "mu0"), ("V0", "v0"), *([("B", "b")] if inputs else [])]
        out += [f"SELECT {k} AS round, '{n}' AS name, 0 AS i, 0 AS j, {e} AS value FROM par{k}" for n, e in scalars]
        out += [f"SELECT {k}, 'C', var, 0, c FROM obs{k}", f"SELECT {k}, 'd', 0, var, d FROM obs{k}", f"SELECT {k}, 'R', 0, var, r FROM obs{k}", f"SELECT {k}, 'loglik', 0, 0, ll FROM ll{k - 1}"]
    return f"SELECT CAST(round AS INTEGER) AS round, name, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(value, 4) + 0.0 AS value FROM ({' UNION ALL '.join(out)})"


def _scalar_start(spark, sf, inputs: bool):
    """A panel in one latent dimension: loadings and noise share each variable's variance."""
    y, p = masked_counts(spark, sf), kinds(spark, sf)
    got = {r["var"]: r for r in y.groupBy("var").agg(F.avg("y").alias("m"), F.var_pop("y").alias("v")).collect()}  # one row a variable
    half = np.array([max(got[i]["v"], 1e-6) / 2 for i in range(p)])
    one = np.array([[1.0]])
    model = kalman.Model(0.8 * one, 0.36 * one, np.zeros(1), one, np.sqrt(half)[:, None], np.array([got[i]["m"] for i in range(p)]), half, 0 * one if inputs else None)
    packed = lagcov.packed(y, p, every_step=True)
    u = packed.select("trial", "t", F.array((F.pmod(F.col("t") + F.col("trial"), F.lit(6)) / 6.0)).alias("u"))
    return packed, model, u


@query("em_inputs", f"WITH RECURSIVE {_em_sql(2, inputs=True)} {_table_sql(2, True)}")
def em_inputs(spark, sf):
    """Parameters by round, with an input of the hour: variables that are seen together share their sums, days are cut into segments."""
    packed, model, u = _scalar_start(spark, sf, True)
    #: (t + var) % 5 decides what is seen, so variables five apart are one group.
    groups = np.arange(len(model.d)) % 5
    return rounded(fitting.saved_rounds(packed, model, 2, inputs=u, groups=groups, segment=9), 4)


@query("em_scalar", f"WITH RECURSIVE {_em_sql(3, inputs=False)} {_table_sql(3, False)}")
def em_scalar(spark, sf):
    packed, model, _ = _scalar_start(spark, sf, False)
    return rounded(fitting.saved_rounds(packed, model, 3), 4)


@query("online_em_scalar", f"WITH RECURSIVE {_em_sql(3, inputs=False, batches=3)} SELECT CAST(batch AS INTEGER) AS batch, CAST(trials AS INTEGER) AS trials, round(ll / trials, 4) + 0.0 AS loglik FROM ({' UNION ALL '.join(f'SELECT {k} AS batch, * FROM ll{k}' for k in range(3))})")
def online_em_scalar(spark, sf):
    """Mean log-likelihood of each third of the days under the model that was learned from the thirds before."""
    packed, model, _ = _scalar_start(spark, sf, False)
    _, trace = fitting.online(packed, model, batches=3, deal=F.pmod(F.col("trial"), F.lit(3)))
    return rounded(spark.createDataFrame([(k, n, x) for k, (n, x) in enumerate(trace)], "batch int, trials int, loglik double"), 4)


LONG = dict(a=0.95, q=0.01, r=0.02)


@query("kalman_smoother_long", f"""WITH RECURSIVE {VECTORS},
par0 AS (SELECT {LONG['a']}::DOUBLE AS a, {LONG['q']}::DOUBLE AS q, 0.0::DOUBLE AS b, 0.0::DOUBLE AS mu0, 1.0::DOUBLE AS v0),
i0 AS MATERIALIZED (SELECT 0 AS trial, t, 0.0::DOUBLE AS u, sum(CASE WHEN (t + var) % 3 <> 0 THEN pow((var + 1) / 64.0, 2) / {LONG['r']} END) AS s, sum(CASE WHEN (t + var) % 3 <> 0 THEN (var + 1) / 64.0 * y / {LONG['r']} END) AS w FROM e GROUP BY t),
{_infer_sql(0)} SELECT t, round(x, 6) + 0.0 AS x, round(vs, 8) AS v FROM sb0""")
def kalman_smoother_long(spark, sf):
    """All vectors as one trial, a third of the cells unseen: its steps are smoothed in segments, by many tasks."""
    v, p = panels.vectors(spark, sf), len(panels.table(spark, sf, "embeddings").select("embedding").first()[0])
    one = np.array([[1.0]])
    model = kalman.Model(LONG["a"] * one, LONG["q"] * one, np.zeros(1), one, ((np.arange(p) + 1) / 64.0)[:, None], np.zeros(p), np.full(p, LONG["r"]))
    seen = v.select(F.lit(0).alias("trial"), "t", "var", F.when((F.col("t") + F.col("var")) % 3 != 0, F.col("y")).alias("y"))
    made = scan.posterior(lagcov.packed(seen, p, every_step=True), model, steps=100)
    return made.select("t", (F.round(F.get("x", F.lit(0)), 6) + 0.0).alias("x"), F.round(F.get("v", F.lit(0)), 8).alias("v"))


#: Newton's method from the logarithm of the mean, carried on long after it has settled: what counts is where it ends.
def _optimum_sql(rounds: int = 25) -> str:
    parts = ["c0 AS (SELECT var, ln(sum(y) / sum(exp(m + v / 2))) AS b0, 0.0::DOUBLE AS b1 FROM r GROUP BY var)"]
    for i in range(rounds):
        parts.append(f"""s{i} AS (SELECT var, b0, b1, sum(y - exp(d)) - 0.1 * b0 AS g0, sum((y - exp(d)) * u) - 0.1 * b1 AS g1, sum(exp(d)) + 0.1 AS h00, sum(exp(d) * u) AS h01, sum(exp(d) * u * u) + 0.1 AS h11
FROM (SELECT var, y, u, b0, b1, b0 + b1 * u + m + v / 2 AS d FROM r JOIN c{i} USING (var)) GROUP BY var, b0, b1),
c{i + 1} AS MATERIALIZED (SELECT var, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM s{i})""")
    return ",\n".join(parts)


@query("poisson_regression", f"""WITH {COUNTS}, r AS MATERIALIZED (SELECT var, CAST(y AS DOUBLE) AS y, t / 24.0::DOUBLE AS u, CASE WHEN t < 12 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END AS m, 0.05::DOUBLE AS v FROM y),
{_optimum_sql()} SELECT var, round(b0, 5) + 0.0 AS b0, round(b1, 5) + 0.0 AS b1, round(sum(exp(d) - y * d) + 0.05 * (b0 * b0 + b1 * b1), 3) AS loss, 0.0::DOUBLE AS slope
FROM (SELECT var, y, b0, b1, b0 + b1 * u + m + v / 2 AS d FROM r JOIN c25 USING (var)) GROUP BY var, b0, b1""")
def poisson_regression(spark, sf):
    """Counts by the hour, with a known offset and its variance; slope: the largest entry of the gradient, zero at the optimum."""
    y = counts(spark, sf)
    offset = F.when(F.col("t") < 12, 0.1).otherwise(F.lit(-0.1))
    rows = y.select("var", F.col("y").cast("double").alias("y"), F.array(F.lit(1.0), F.col("t") / 24.0).alias("z"), (offset + 0.05 / 2).alias("offset"))
    made = learning.poisson_regression(rows, 2, penalty=0.1)
    b = lambda k: (F.round(F.get("b", F.lit(k)), 5) + 0.0).alias(f"b{k}")
    return made.select("var", b(0), b(1), F.round("loss", 3).alias("loss"), F.round("slope", 3).alias("slope"))


@query("poisson_psth", f"WITH {COUNTS} SELECT var, CAST(t // 4 AS INTEGER) AS part, round(ln(sum(y) / sum(exp(CASE WHEN t % 2 = 0 THEN 0.2 ELSE 0.0 END))), 5) + 0.0 AS b FROM y GROUP BY ALL")
def poisson_psth(spark, sf):
    """Log rates of each variable in six parts of the day, as one regression on six regressors."""
    part = F.floor(F.col("t") / 4)
    z = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (k == part).cast("double"))
    rows = counts(spark, sf).select("var", F.col("y").cast("double").alias("y"), z.alias("z"), F.when(F.col("t") % 2 == 0, 0.2).otherwise(F.lit(0.0)).alias("offset"))
    made = learning.poisson_regression(rows, 6, penalty=0.0)
    return made.select("var", F.posexplode("b").alias("part", "b")).select("var", "part", (F.round("b", 5) + 0.0).alias("b"))


def _history_sql(rounds: int = 25) -> str:
    """Newton's method for loading c, offset d and history weight w of each variable, carried on until it has settled."""
    parts = ["c0 AS (SELECT var, 0.0::DOUBLE AS c, ln(avg(y)) AS d, 0.0::DOUBLE AS w FROM r GROUP BY var)"]
    for i in range(rounds):
        parts.append(f"""s{i} AS (SELECT var, c, d, w, sum(y * x - q * l) - 0.1 * c AS g0, sum(y - q) - 0.1 * d AS g1, sum((y - q) * h) - 0.1 * w AS g2,
  sum(q * (l * l + v)) + 0.1 AS h00, sum(q * l) AS h01, sum(q * l * h) AS h02, sum(q) + 0.1 AS h11, sum(q * h) AS h12, sum(q * h * h) + 0.1 AS h22
  FROM (SELECT *, x + v * c AS l, exp(c * x + d + w * h + c * c * v / 2) AS q FROM r JOIN c{i} USING (var)) GROUP BY var, c, d, w),
i{i} AS (SELECT *, h11 * h22 - h12 * h12 AS a00, h02 * h12 - h01 * h22 AS a01, h01 * h12 - h02 * h11 AS a02, h00 * h22 - h02 * h02 AS a11, h01 * h02 - h00 * h12 AS a12, h00 * h11 - h01 * h01 AS a22 FROM s{i}),
c{i + 1} AS MATERIALIZED (SELECT var, c + (a00 * g0 + a01 * g1 + a02 * g2) / z AS c, d + (a01 * g0 + a11 * g1 + a12 * g2) / z AS d, w + (a02 * g0 + a12 * g1 + a22 * g2) / z AS w
  FROM (SELECT *, h00 * a00 + h01 * a01 + h02 * a02 AS z FROM i{i}))""")
    return ",\n".join(parts)


@query("observation_step_history", f"""WITH {COUNTS}, r AS MATERIALIZED (SELECT * FROM (
  SELECT var, CAST(y AS DOUBLE) AS y, t / 24.0::DOUBLE - 0.5 AS x, 0.02::DOUBLE + t / 2400.0::DOUBLE AS v, CAST(lag(y) OVER (PARTITION BY trial, var ORDER BY t) AS DOUBLE) AS h FROM y) WHERE h IS NOT NULL),
{_history_sql()} SELECT var, round(c, 5) + 0.0 AS c, round(d, 5) + 0.0 AS d, round(w, 5) + 0.0 AS w, 0.0::DOUBLE AS slope FROM c25""")
def observation_step_history(spark, sf):
    """Loadings, offsets and weights of the last count, given states of which a mean and a variance are known."""
    y = counts(spark, sf)
    t = F.col("t").cast("double")
    states = y.select("trial", "t").distinct().select("trial", "t", F.array(t / 24 - 0.5).alias("x"), F.array(t / 2400 + 0.02).alias("v"))
    made = learning.observation_step(y, states, 1, past=1)
    one = lambda x, name: (F.round(x, 5) + 0.0).alias(name)
    return made.select("var", one(F.get("c", F.lit(0)), "c"), one(F.col("d"), "d"), one(F.get("w", F.lit(0)), "w"), F.round("slope", 3).alias("slope"))


LINK = """nodes AS (SELECT 16.0::DOUBLE * z / 320 - 8 AS z FROM range(321) r(z)),
tab AS (SELECT CAST(i AS INTEGER) AS i, CAST(k AS INTEGER) AS k, -6.0::DOUBLE + i * 0.25 AS m, k * 0.25::DOUBLE AS s FROM range(49) a(i), range(13) b(k)),
lt AS MATERIALIZED (SELECT i, k, m, s, sum(exp(-z * z / 2) * (greatest(m + s * z, 0) + ln(1 + exp(-abs(m + s * z))))) / sum(exp(-z * z / 2)) AS value FROM tab, nodes GROUP BY ALL)"""


@query("link_lookup", f"""WITH {COUNTS}, {LINK}, g AS (SELECT var, t, avg(y) AS m, stddev_pop(y) AS s FROM y GROUP BY ALL),
p AS (SELECT *, least(greatest((m + 6) / 0.25, 0), 48) AS x, least(greatest(s / 0.25, 0), 12) AS w FROM g),
c AS (SELECT *, CAST(least(floor(x), 47) AS INTEGER) AS i, CAST(least(floor(w), 11) AS INTEGER) AS k FROM p)
SELECT c.var, c.t, round((1 - (x - c.i)) * ((1 - (w - c.k)) * a.value + (w - c.k) * b.value) + (x - c.i) * ((1 - (w - c.k)) * d.value + (w - c.k) * e.value), 6) AS expected
FROM c JOIN lt a ON a.i = c.i AND a.k = c.k JOIN lt b ON b.i = c.i AND b.k = c.k + 1 JOIN lt d ON d.i = c.i + 1 AND d.k = c.k JOIN lt e ON e.i = c.i + 1 AND e.k = c.k + 1""")
def link_lookup(spark, sf):
    """What log(1 + exp(x)) is on average for an x with the mean and deviation of each variable's counts at each hour, by a table."""
    rows = counts(spark, sf).groupBy("var", "t").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    return rounded(links.expected(rows, links.table(spark, links.softplus), "m", "s", "expected").select("var", "t", "expected"))


@query("subpop_tree", f"""WITH RECURSIVE {SCHEME},
ed AS MATERIALIZED (SELECT x.pop_id AS a, list_sort(list_distinct(list(y.pop_id))) AS near FROM sp x JOIN sp y USING (var) WHERE x.pop_id <> y.pop_id GROUP BY x.pop_id),
w AS (
  SELECT [0] AS stack, [0] AS claimed, [0] AS pops, [-1] AS parents
  UNION ALL
  SELECT list_concat(own, stack[2:]), list_concat(claimed, own), list_concat(pops, own), list_concat(parents, list_transform(own, lambda x: stack[1]))
  FROM (SELECT w.*, list_filter(coalesce(ed.near, []), lambda x: NOT list_contains(w.claimed, x)) AS own FROM w LEFT JOIN ed ON ed.a = w.stack[1] WHERE len(w.stack) > 0)),
r AS (SELECT pops, parents FROM w WHERE len(stack) = 0)
SELECT CAST(unnest(pops) AS INTEGER) AS pop_id, nullif(CAST(unnest(parents) AS INTEGER), -1) AS parent, CAST(unnest(range(len(pops))) AS INTEGER) AS place FROM r""")
def subpop_tree(spark, sf):
    return scheme.tree(_pops(spark, sf))


@query("variational_inference")
def variational_inference(spark, sf):
    """Posterior of two states behind the counts of each day, with the bound of its evidence and the gap to the dual."""
    rows, model = _poisson_start(spark, sf)
    return variational.posterior(rows, model)


@query("laplace_softplus")
def laplace_softplus(spark, sf):
    """The most likely states behind counts whose rates are log(1 + exp(C x + d))."""
    rows, model = _start(spark, sf)
    return poisson.posterior(rows, model, link="softplus")


@query("hankel_sgd")
def hankel_sgd(spark, sf):
    """The loss of a system on lagged products of the counts by round of stochastic descent."""
    p = kinds(spark, sf)
    rows = hankel_descent.pairs(masked_counts(spark, sf), p, 3)
    level = float(np.sqrt(counts(spark, sf).agg(F.avg("y")).first()[0] or 1.0))
    _, trace = hankel_descent.fit(rows, hankel_descent.started(p, 2, 3, scale=level), rounds=12, batches=2, rate=0.05 * level)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(trace)], "round int, loss double")


@query("stitched_lagcov")
def stitched_lagcov(spark, sf):
    """Lag covariances of all pairs of variables from models of the populations, most pairs of which share no population."""
    v = panels.vectors(spark, sf)
    pops = panels.subpops(v)
    q = lagcov.lag_cov(v.select(F.lit(0).alias("trial"), "t", "var", "y"), dims(spark, sf), 4)
    loadings, inner, noise = partial_models.stitched(q, pops, scheme.tree(pops), 2, 2)
    return lagcov.model_cov(loadings, inner, noise)


@query("expfam_pca")
def expfam_pca(spark, sf):
    """The penalised loss of one component of the counts by turn over loadings and factors."""
    _, _, losses = count_factors.factored(masked_counts(spark, sf), 1, turns=3)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(losses)], "turn int, loss double")


@query("low_rank_rates")
def low_rank_rates_of_counts(spark, sf):
    """Rates of low rank behind the counts, also where they aren't seen: one row a day, hour and event type."""
    made = low_rank_rates.fit(masked_counts(spark, sf), kinds(spark, sf), strength=0.1, eps_rel=1e-4)
    return made.rates.select("trial", "t", F.posexplode("x").alias("var", "x"))


#: Days whose first half has long steps and whose second half short ones, of a process with decay 0.3 and noise 0.6 an unit of time.
TIMES = dict(dts=[1.0, 0.25], decay=0.3, noise=0.6)
_TIMES_SQL = MASKED + f""",
o AS (SELECT var, avg(y) AS d, greatest(var_pop(y), 1e-6) / 2 AS r FROM k WHERE y IS NOT NULL GROUP BY var),
i AS MATERIALIZED (SELECT trial, t, CASE WHEN t < 12 THEN {TIMES['dts'][0]}::DOUBLE ELSE {TIMES['dts'][1]}::DOUBLE END AS dt, CAST(count(y) AS DOUBLE) AS s, coalesce(sum(sqrt(r) * (y - d) / r), 0) AS w FROM k JOIN o USING (var) GROUP BY ALL),
st AS MATERIALIZED (SELECT *, exp(-{TIMES['decay']} * dt) AS a, {TIMES['noise']} * (1 - exp(-2 * {TIMES['decay']} * dt)) / (2 * {TIMES['decay']}) AS q FROM i),
f AS (
  SELECT trial, t, 0.0::DOUBLE AS m, 1.0::DOUBLE AS p, w / (1 + s) AS mu, 1 / (1 + s) AS v FROM st WHERE t = 0
  UNION ALL
  SELECT st.trial, st.t, a * mu, a * a * v + q, a * mu + (w - s * a * mu) / (1 / (a * a * v + q) + s), 1 / (1 / (a * a * v + q) + s) FROM f JOIN st ON st.trial = f.trial AND st.t = f.t + 1),
g AS MATERIALIZED (SELECT * FROM f),
bk AS (
  SELECT trial, t, mu AS x, v AS vs FROM g WHERE t = (SELECT max(t) FROM g)
  UNION ALL
  SELECT e.trial, e.t, e.mu + e.v * st.a / n.p * (bk.x - n.m), e.v + pow(e.v * st.a / n.p, 2) * (bk.vs - n.p)
  FROM bk JOIN g n ON n.trial = bk.trial AND n.t = bk.t JOIN st ON st.trial = bk.trial AND st.t = bk.t JOIN g e ON e.trial = bk.trial AND e.t = bk.t - 1)"""


def _timed(spark, sf):
    """The panel, when step lengths change, and a process in continuous time seen by all event types."""
    packed, model, _ = _scalar_start(spark, sf, False)
    schedule = packed.select("trial").distinct().select("trial", F.explode(F.array(F.struct(F.lit(0).alias("t"), F.lit(0).alias("scale")), F.struct(F.lit(12).alias("t"), F.lit(1).alias("scale")))).alias("s")).select("trial", "s.*")
    one = np.array([[1.0]])
    return packed, schedule, timescales.timed(model, -TIMES["decay"] * one, TIMES["noise"] * one, TIMES["dts"])


@query("kalman_smoother_timescales", f"WITH RECURSIVE {_TIMES_SQL} SELECT trial, t, round(x, 6) + 0.0 AS x, round(vs, 8) AS v FROM bk")
def kalman_smoother_timescales(spark, sf):
    """Days as a process in continuous time whose steps are four times shorter from noon on, smoothed in segments."""
    made = timescales.posterior(*_timed(spark, sf), steps=9)
    return made.select("trial", "t", (F.round(F.get("x", F.lit(0)), 6) + 0.0).alias("x"), F.round(F.get("v", F.lit(0)), 8).alias("v"))


@query("em_timescales")
def em_timescales(spark, sf):
    """The log-likelihood by round of a fit in which each step length has its own move."""
    packed, schedule, model = _timed(spark, sf)
    _, trace = timescales.fit(packed, schedule, model, rounds=4)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(trace)], "round int, loglik double")
