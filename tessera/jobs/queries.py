"""The panel operators as queries over the given tables, with DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import likelihoods as L
from tessera.jobs import fitting, poisson, stitching
from tessera.operators import asof, graphs, kalman, lagcov, panel, regression, sampling, scheme
from tessera.operators.panel import rounded
from tessera.sources import panels
from tessera.streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOURS = 24


def kinds(spark: SparkSession, sf: str) -> int:
    """The number of event types, which are the variables of the count panels."""
    return panels.table(spark, sf, "events").select("event_type").distinct().count()


def dims(spark: SparkSession, sf: str) -> int:
    """The number of variables of the vector panels."""
    return panels.table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0



#: Shared table expressions of the SQL side: counts (y), vectors (e), populations (sp), schedule (sc).
SPIKES = """
v AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS var FROM (SELECT DISTINCT event_type FROM events)),
sk AS (SELECT CAST((epoch_us(ts) - 1704067200000000) // 86400000000 AS INTEGER) AS trial, var, ((epoch_us(ts) - 1704067200000000) % 86400000000) / 3.6e9 AS ts, value FROM events JOIN v USING (event_type))"""
COUNTS = SPIKES + """,
n AS (SELECT trial, var, CAST(floor(ts) AS INTEGER) AS t, count(*) AS y FROM sk GROUP BY ALL),
y AS (SELECT a.trial, b.var, CAST(c.t AS INTEGER) AS t, CAST(coalesce(n.y, 0) AS BIGINT) AS y
  FROM (SELECT DISTINCT trial FROM n) a CROSS JOIN (SELECT DISTINCT var FROM n) b CROSS JOIN range(24) c(t)
  LEFT JOIN n ON n.trial = a.trial AND n.var = b.var AND n.t = c.t)"""
VECTORS = "e AS (SELECT label AS experiment, CAST(vec_id AS INTEGER) AS t, CAST(i - 1 AS INTEGER) AS var, CAST(embedding[i] AS DOUBLE) AS y FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
SCHEME = VECTORS + """,
vr AS (SELECT DISTINCT var FROM e),
sp AS (SELECT CAST(p AS INTEGER) AS pop_id, var FROM vr, range(0, (SELECT max(var) // 16 + 1 FROM vr)) r(p) WHERE var BETWEEN 16 * p - 4 AND 16 * p + 19),
ln AS (SELECT max(t) + 1 AS len FROM e),
sc AS (SELECT CAST(s AS INTEGER) AS seg, CAST(s * len // 4 AS INTEGER) AS t_start, CAST((s + 1) * len // 4 AS INTEGER) AS t_end, CAST(s AS INTEGER) AS pop_id FROM ln, range(4) r(s))"""
GROUPS = SCHEME + """,
pat AS (SELECT var, string_agg(pop_id, '-' ORDER BY pop_id) AS pattern FROM sp GROUP BY var),
gn AS (SELECT pattern, CAST(row_number() OVER (ORDER BY min(var)) - 1 AS INTEGER) AS grp FROM pat GROUP BY pattern),
ig AS (SELECT var, pattern, grp FROM pat JOIN gn USING (pattern))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return panel.bin_spike_times(panels.spikes(spark, sf), 1.0, HOURS)


def masked_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts in which variable var isn't seen in bins where (t + var) % 5 = 0."""
    return counts(spark, sf).withColumn("y", F.when((F.col("t") + F.col("var")) % 5 != 0, F.col("y").cast("double")))


MASKED = COUNTS + ", k AS (SELECT trial, var, t, CASE WHEN (t + var) % 5 <> 0 THEN CAST(y AS DOUBLE) END AS y FROM y)"

query("bin_spike_times", f"WITH {COUNTS} SELECT trial, var, t, y FROM y")(counts)


@query("rebin_raster", f"WITH {COUNTS} SELECT trial, var, CAST(t // 5 AS INTEGER) AS t, CAST(sum(y) AS BIGINT) AS y FROM y WHERE t < 20 GROUP BY ALL")
def rebin_raster(spark, sf):
    return panel.rebin(counts(spark, sf), 5, HOURS)


@query("subsample_signal", f"WITH {COUNTS} SELECT trial, var, CAST(t // 5 AS INTEGER) AS t, y FROM y WHERE t % 5 = 0 AND t < 20")
def subsample_signal(spark, sf):
    return panel.subsample(counts(spark, sf), 5, HOURS)


@query("traces_y", f"WITH {VECTORS} SELECT * FROM e WHERE experiment IN (0, 1) AND var IN (0, 5, 9, 63) AND t < 150")
def traces_y(spark, sf):
    return panel.traces(panels.vectors(spark, sf), experiment=[0, 1], var=[0, 5, 9, 63]).where("t < 150")


@query("catalog", f"WITH {VECTORS} SELECT experiment, count(DISTINCT t) AS n_t, CAST(max(t) + 1 AS BIGINT) AS length, count(DISTINCT var) AS n_var, count(*) AS n_cells FROM e GROUP BY experiment")
def catalog(spark, sf):
    return panel.catalog(panels.vectors(spark, sf))


@query("delete_experiments", f"WITH {VECTORS} SELECT experiment, count(*) AS n FROM e WHERE experiment NOT IN (0, 2) GROUP BY experiment")
def delete_experiments(spark, sf):
    return panels.vectors(spark, sf).where(~F.col("experiment").isin(0, 2)).groupBy("experiment").agg(F.count("*").alias("n"))


@query("apply_scheme", f"WITH {SCHEME} SELECT experiment, t, var, CASE WHEN sp.var IS NOT NULL THEN y END AS y FROM e JOIN sc ON t >= t_start AND t < t_end LEFT JOIN sp USING (pop_id, var)")
def apply_scheme(spark, sf):
    v = panels.vectors(spark, sf)
    return panel.apply_scheme(v, panels.subpops(v), panels.schedule(v))


@query("check_scheme", f"""WITH {SCHEME}, g AS (SELECT *, lag(t_end, 1, 0) OVER (ORDER BY seg) AS before FROM sc)
SELECT 'uncovered_variable' AS rule, count(*) AS violations FROM vr WHERE var NOT IN (SELECT var FROM sp)
UNION ALL SELECT 'gap_in_time', count(*) FROM g WHERE t_start <> before UNION ALL SELECT 'empty_segment', count(*) FROM sc WHERE t_end <= t_start
UNION ALL SELECT 'unknown_population', count(*) FROM sc WHERE pop_id NOT IN (SELECT pop_id FROM sp) UNION ALL SELECT 'wrong_end', count(*) FROM (SELECT max(t_end) AS x FROM sc), ln WHERE x <> len""")
def check_scheme(spark, sf):
    v = panels.vectors(spark, sf)
    return scheme.check(v, panels.subpops(v), panels.schedule(v))


def _pops(spark, sf):
    return panels.subpops(panels.vectors(spark, sf))


@query("index_groups", f"WITH {GROUPS} SELECT var, pattern, grp FROM ig")
def index_groups(spark, sf):
    return scheme.index_groups(_pops(spark, sf))


@query("index_overlaps", f"WITH {GROUPS} SELECT grp, count(DISTINCT pop_id) AS n_pops, string_agg(DISTINCT pop_id, ',' ORDER BY pop_id) AS pops FROM sp JOIN ig USING (var) GROUP BY grp HAVING count(DISTINCT pop_id) > 1")
def index_overlaps(spark, sf):
    return scheme.index_overlaps(_pops(spark, sf))


@query("visible_groups", f"WITH {GROUPS} SELECT DISTINCT seg, grp FROM sc JOIN sp USING (pop_id) JOIN ig USING (var)")
def visible_groups(spark, sf):
    v = panels.vectors(spark, sf)
    return scheme.visible_groups(panels.subpops(v), panels.schedule(v))


@query("co_observed", f"WITH {GROUPS}, vg AS (SELECT DISTINCT seg, grp FROM sc JOIN sp USING (pop_id) JOIN ig USING (var)) SELECT DISTINCT a.grp AS grp_a, b.grp AS grp_b FROM vg a JOIN vg b USING (seg)")
def co_observed(spark, sf):
    v = panels.vectors(spark, sf)
    return scheme.co_observed(panels.subpops(v), panels.schedule(v))


@query("index_masks", f"WITH {SCHEME} SELECT a.var AS i, b.var AS j, count(*) AS n_pops FROM sp a JOIN sp b USING (pop_id) GROUP BY ALL")
def index_masks(spark, sf):
    return scheme.observed_pairs(_pops(spark, sf))


@query("stitch_pairs", f"WITH {SCHEME} SELECT a.var AS i, b.var AS j FROM vr a JOIN vr b ON a.var < b.var WHERE NOT EXISTS (SELECT 1 FROM sp x JOIN sp y USING (pop_id) WHERE x.var = a.var AND y.var = b.var)")
def stitch_pairs(spark, sf):
    return scheme.stitched_pairs(_pops(spark, sf))


@query("find_overlaps", f"WITH {SCHEME} SELECT x.pop_id AS a, y.pop_id AS b, count(*) AS n_shared FROM sp x JOIN sp y USING (var) WHERE x.pop_id < y.pop_id GROUP BY ALL")
def find_overlaps(spark, sf):
    return scheme.overlaps(_pops(spark, sf))


@query("traverse_subpops", f"""WITH RECURSIVE {SCHEME}, ed AS (SELECT DISTINCT x.pop_id AS a, y.pop_id AS b FROM sp x JOIN sp y USING (var) WHERE x.pop_id <> y.pop_id),
w AS (SELECT 0 AS pop_id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN ed ON a = pop_id WHERE depth < (SELECT count(DISTINCT pop_id) FROM sp)) SELECT CAST(pop_id AS INTEGER) AS pop_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY pop_id""")
def traverse_subpops(spark, sf):
    return scheme.traversal(_pops(spark, sf))


@query("union_cover", f"WITH {SCHEME} SELECT var FROM sp WHERE pop_id = 0 UNION SELECT var FROM sp WHERE pop_id = 1")
def union_cover(spark, sf):
    p = _pops(spark, sf)
    return scheme.members(p, 0).union(scheme.members(p, 1)).distinct()


@query("intersect_overlap", f"WITH {SCHEME} SELECT var FROM sp WHERE pop_id = 0 INTERSECT SELECT var FROM sp WHERE pop_id = 1")
def intersect_overlap(spark, sf):
    p = _pops(spark, sf)
    return scheme.members(p, 0).intersect(scheme.members(p, 1))


@query("except_vars", f"WITH {SCHEME} SELECT var FROM vr EXCEPT SELECT var FROM sp WHERE pop_id = 1")
def except_vars(spark, sf):
    v = panels.vectors(spark, sf)
    return v.select("var").distinct().subtract(scheme.members(panels.subpops(v), 1))


@query("unobserved_anti", f"WITH {SCHEME} SELECT seg, var FROM sc CROSS JOIN vr WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.pop_id = sc.pop_id AND sp.var = vr.var)")
def unobserved_anti(spark, sf):
    v = panels.vectors(spark, sf)
    grid = panels.schedule(v).join(v.select("var").distinct(), how="cross")
    return grid.join(panels.subpops(v), ["pop_id", "var"], "left_anti").select("seg", "var")


@query("argmax_subpop", f"WITH {SCHEME} SELECT pop_id, count(*) AS n FROM sp GROUP BY pop_id ORDER BY n DESC, pop_id LIMIT 1")
def argmax_subpop(spark, sf):
    return _pops(spark, sf).groupBy("pop_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pop_id").limit(1)


@query("idx_global2local", f"WITH {SCHEME} SELECT pop_id, var, CAST(row_number() OVER (PARTITION BY pop_id ORDER BY var) - 1 AS INTEGER) AS pos FROM sp")
def idx_global2local(spark, sf):
    return scheme.local_index(_pops(spark, sf))


@query("trial_mean_center", f"WITH {COUNTS} SELECT trial, var, t, round(y - avg(y) OVER (PARTITION BY trial, var), 6) + 0.0 AS y FROM y")
def trial_mean_center(spark, sf):
    return rounded(panel.center(counts(spark, sf)))


@query("lag_lead", f"WITH {COUNTS} SELECT trial, var, t, y, lag(y) OVER w AS y_prev, lead(y) OVER w AS y_next FROM y WINDOW w AS (PARTITION BY trial, var ORDER BY t)")
def lag_lead(spark, sf):
    return panel.lag_lead(counts(spark, sf))


@query("hankel_data", f"WITH {COUNTS} SELECT trial, var, t, array_to_string(w, ',') AS w FROM (SELECT trial, var, t, list(y) OVER (PARTITION BY trial, var ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS w FROM y) WHERE len(w) = 4")
def hankel_data(spark, sf):
    rows = panel.windows(counts(spark, sf), 4)
    return rows.withColumn("w", F.array_join(F.transform("w", lambda x: x.cast("string")), ","))


@query("history_terms", f"WITH {COUNTS} SELECT * FROM (SELECT trial, var, t, y, lag(y, 1) OVER w AS h1, lag(y, 2) OVER w AS h2, lag(y, 3) OVER w AS h3 FROM y WINDOW w AS (PARTITION BY trial, var ORDER BY t)) WHERE h3 IS NOT NULL")
def history_terms(spark, sf):
    return panel.history(counts(spark, sf), 3)


@query("concat_trials", f"WITH {COUNTS}, o AS (SELECT trial, coalesce(sum(max(t) + 1) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM y GROUP BY trial) SELECT CAST(t + o AS BIGINT) AS t, var, y FROM y JOIN o USING (trial)")
def concat_trials(spark, sf):
    return panel.concat_trials(counts(spark, sf))


@query("drop_silent_rows", f"WITH {COUNTS} SELECT var, count(*) AS n FROM y WHERE var IN (SELECT var FROM y GROUP BY var HAVING sum(y) <> 0) GROUP BY var")
def drop_silent_rows(spark, sf):
    return panel.silent(counts(spark, sf)).groupBy("var").agg(F.count("*").alias("n"))


def _hours(spikes: DataFrame) -> float:
    """Hours of the days that the spikes span."""
    return float((spikes.agg(F.max("trial") - F.min("trial") + 1).first()[0] or 1) * HOURS)


@query("rate_filter", f"WITH {SPIKES}, h AS (SELECT (max(trial) - min(trial) + 1) * 24.0 AS hours FROM sk) SELECT var, count(*) AS n, round(count(*) / any_value(hours), 6) AS rate FROM sk CROSS JOIN h GROUP BY var HAVING count(*) / any_value(hours) >= 1.0")
def rate_filter(spark, sf):
    s = panels.spikes(spark, sf)
    return rounded(panel.rates(s, _hours(s), 1.0))


@query("psth_layout", f"WITH {COUNTS} SELECT var, t, round(avg(y), 6) AS rate, count(*) AS n_trials FROM y GROUP BY ALL")
def psth_layout(spark, sf):
    return rounded(panel.psth(counts(spark, sf)))


@query("spike_stats", f"WITH {COUNTS} SELECT var, max(y) AS most, round(avg(y), 6) AS mean, round(avg(CASE WHEN y <> 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM y GROUP BY var")
def spike_stats(spark, sf):
    return rounded(panel.spike_stats(counts(spark, sf)))


@query("clip", f"WITH {COUNTS} SELECT trial, var, t, least(greatest(y, 1), 3) AS y FROM y")
def clip(spark, sf):
    return counts(spark, sf).withColumn("y", F.least(F.greatest("y", F.lit(1)), F.lit(3)))


@query("nan_mean", f"WITH {MASKED} SELECT var, round(avg(y), 6) AS mean, count(y) AS n FROM k GROUP BY var")
def nan_mean(spark, sf):
    return rounded(lagcov.nan_mean(masked_counts(spark, sf)))


@query("coobs_count", f"WITH {MASKED} SELECT a.var AS i, b.var AS j, count(*) AS n FROM k a JOIN k b USING (trial, t) WHERE a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY ALL")
def coobs_count(spark, sf):
    y = masked_counts(spark, sf)
    return lagcov.coobs_count(y, (y.agg(F.max("var")).first()[0] or 0) + 1)


CENTERED = MASKED + ", z AS (SELECT trial, var, t, y - avg(y) OVER (PARTITION BY var) AS z FROM k QUALIFY y IS NOT NULL)"
LINEAR = CENTERED + ", q AS (SELECT CAST(m AS INTEGER) AS m, a.var AS i, b.var AS j, avg(a.z * b.z) AS q, count(*) AS n FROM z a CROSS JOIN range(4) r(m) JOIN z b ON a.trial = b.trial AND b.t = a.t - m GROUP BY ALL)"


def linear(spark, sf, lags=4):
    return lagcov.lag_cov(masked_counts(spark, sf), kinds(spark, sf), lags)


@query("lag_cov_linear", f"WITH {LINEAR} SELECT m, i, j, round(q, 6) + 0.0 AS q, n FROM q")
def lag_cov_linear(spark, sf):
    return rounded(linear(spark, sf))


@query("lag_cov_circ", f"""WITH {CENTERED}, s AS (SELECT CAST(m AS INTEGER) AS m, a.var AS i, b.var AS j, sum(a.z * b.z) AS s, count(*) AS n FROM z a CROSS JOIN range(4) r(m) JOIN z b ON a.trial = b.trial AND b.t = (a.t - m + 24) % 24 GROUP BY ALL)
SELECT m, i, j, round(s / n0, 6) + 0.0 AS q, n0 AS n FROM s JOIN (SELECT i, j, n AS n0 FROM s WHERE m = 0) USING (i, j)""")
def lag_cov_circ(spark, sf):
    return rounded(lagcov.lag_cov(masked_counts(spark, sf), kinds(spark, sf), 4, circular=True, length=HOURS))


@query("lag_cov_vectors", f"""WITH {VECTORS}, z AS (SELECT t, var, y - avg(y) OVER (PARTITION BY var) AS z FROM e)
SELECT CAST(m AS INTEGER) AS m, a.var AS i, b.var AS j, round(avg(a.z * b.z), 6) + 0.0 AS q, count(*) AS n FROM z a CROSS JOIN range(2) r(m) JOIN z b ON b.t = a.t - m GROUP BY ALL""")
def lag_cov_vectors(spark, sf):
    v = panels.vectors(spark, sf).select(F.lit(0).alias("trial"), "t", "var", "y")
    return rounded(lagcov.lag_cov(v, dims(spark, sf), 2))


@query("hankel", f"WITH {LINEAR} SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, i, j, round(q, 6) + 0.0 AS q FROM q CROSS JOIN range(2) a(r) CROSS JOIN range(2) b(c) WHERE m = r + c + 1")
def hankel(spark, sf):
    return rounded(lagcov.hankel(linear(spark, sf), 2, 2))


@query("symmetrize", f"WITH {LINEAR} SELECT a.m, a.i, a.j, round((a.q + b.q) / 2, 6) + 0.0 AS q FROM q a JOIN q b ON a.m = b.m AND a.i = b.j AND a.j = b.i")
def symmetrize(spark, sf):
    return rounded(lagcov.symmetrized(linear(spark, sf)))


@query("autocorr", f"""WITH {COUNTS}, z AS (SELECT trial, var, t, y - avg(y) OVER (PARTITION BY var) AS z FROM y),
s AS (SELECT a.var, CAST(m AS INTEGER) AS m, sum(a.z * b.z) AS s FROM z a CROSS JOIN range(6) r(m) JOIN z b ON a.trial = b.trial AND a.var = b.var AND b.t = a.t - m GROUP BY ALL)
SELECT var, m, round(s / s0, 6) + 0.0 AS acf FROM s JOIN (SELECT var, s AS s0 FROM s WHERE m = 0) USING (var)""")
def autocorr(spark, sf):
    return rounded(lagcov.autocorr(counts(spark, sf), kinds(spark, sf), 6))


@query("corr_cov", f"""WITH {LINEAR}, {SPIKES.replace('v AS', 'v2 AS').replace('sk AS', 'sk2 AS').replace('JOIN v USING', 'JOIN v2 USING')},
zc AS (SELECT trial, var, t, y - avg(y) OVER (PARTITION BY var) AS z FROM y),
f AS (SELECT CAST(m AS INTEGER) AS m, a.var AS i, b.var AS j, avg(a.z * b.z) AS q FROM zc a CROSS JOIN range(4) r(m) JOIN zc b ON a.trial = b.trial AND b.t = a.t - m GROUP BY ALL)
SELECT f.m, abs(f.i - f.j) < 2 AS observed, round(corr(f.q, q.q), 6) AS corr, round(avg((f.q - q.q) * (f.q - q.q)), 6) AS mse, count(*) AS n FROM f JOIN q ON f.m = q.m AND f.i = q.i AND f.j = q.j GROUP BY ALL""")
def corr_cov(spark, sf):
    full = lagcov.lag_cov(counts(spark, sf), kinds(spark, sf), 4)
    part = linear(spark, sf)
    near = full.where(F.abs(F.col("i") - F.col("j")) < 2).select("i", "j").distinct()
    return rounded(lagcov.pair_scores(full, part, near))


@query("recon_mse", f"WITH {COUNTS}, p AS (SELECT var, t, avg(y) AS rate FROM y GROUP BY ALL) SELECT var, round(avg((y - rate) * (y - rate)), 6) AS mse FROM y JOIN p USING (var, t) GROUP BY var")
def recon_mse(spark, sf):
    y = counts(spark, sf)
    rows = y.join(panel.psth(y), ["var", "t"])
    return rounded(rows.groupBy("var").agg(F.avg((F.col("y") - F.col("rate")) ** 2).alias("mse")))


@query("col_norms", f"WITH {VECTORS} SELECT var, round(sqrt(sum(y * y)), 6) AS norm FROM e GROUP BY var")
def col_norms(spark, sf):
    return rounded(panels.vectors(spark, sf).groupBy("var").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm")))


@query("links", f"""WITH {VECTORS}, x AS (SELECT t, var, 40 * y AS x FROM e)
SELECT t, var, round(exp(x), 6) AS exp_link, round(CASE WHEN x < 0 THEN exp(x) ELSE 1 + x END, 6) AS soft_link, round(ln(1 + exp(x)), 6) AS logexp_link,
round(CASE WHEN x > 5 THEN x WHEN x < -5 THEN exp(x) ELSE ln(1 + exp(x)) END, 6) AS stable_log_exp, round(CASE WHEN x > 5 THEN ln(x) WHEN x < -5 THEN x ELSE ln(ln(1 + exp(x))) END, 6) AS stable_loglog_exp FROM x""")
def links(spark, sf):
    rows = panels.vectors(spark, sf).withColumn("x", 40 * F.col("y"))
    x = F.col("x")
    return rounded(rows.select("t", "var", F.exp(x).alias("exp_link"), L.soft_link(x).alias("soft_link"), L.logexp_link(x).alias("logexp_link"), L.stable_log_exp(x).alias("stable_log_exp"), L.stable_loglog_exp(x).alias("stable_loglog_exp")))


@query("poisson_scores", f"""WITH {COUNTS}, p AS (SELECT var, t, avg(y) + 0.1 AS rate FROM y GROUP BY ALL)
SELECT trial, var, round(sum(-y * ln(rate) + exp(ln(rate) + 0.05)), 6) AS poisson_like, round(sum(rate * (ln(rate) - 1)), 6) AS poisson_dual, round(-sum(lgamma(y + 1)), 6) + 0.0 AS base_measure, bool_and(rate >= 0) AS in_domain
FROM y JOIN p USING (var, t) GROUP BY ALL""")
def poisson_scores(spark, sf):
    y = counts(spark, sf)
    rate = panel.psth(y).select("var", "t", (F.col("rate") + 0.1).alias("rate"))
    rows = y.join(rate, ["var", "t"])
    like = L.poisson_like(F.col("y"), F.ln("rate"), F.lit(0.1))
    return rounded(rows.groupBy("trial", "var").agg(F.sum(like).alias("poisson_like"), F.sum(L.poisson_dual(F.col("rate"))).alias("poisson_dual"), (-F.sum(L.log_factorial(F.col("y")))).alias("base_measure"), F.bool_and(L.in_domain(F.col("rate"))).alias("in_domain")))


@query("bernoulli_dual", f"""WITH {COUNTS}, p AS (SELECT var, t, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS l FROM y GROUP BY ALL)
SELECT var, t, round(CASE WHEN l > 0 THEN l * ln(l) ELSE 0 END + CASE WHEN l < 1 THEN (1 - l) * ln(1 - l) ELSE 0 END, 6) + 0.0 AS dual FROM p""")
def bernoulli_dual(spark, sf):
    rows = counts(spark, sf).groupBy("var", "t").agg(F.avg((F.col("y") > 0).cast("double")).alias("l"))
    return rounded(rows.select("var", "t", L.bernoulli_dual(F.col("l")).alias("dual")))


SCALAR = dict(a=0.9, q=0.5, c=1.0, d=0.2, r=2.0, mu0=0.0, v0=1.0)
FILTER = MASKED + """,
fl AS (
  SELECT trial, var, t, CASE WHEN y IS NULL THEN 0.0::DOUBLE ELSE (1 / (1 / 2.0::DOUBLE + 1)) * (y - 0.2) / 2.0 END AS mu, CASE WHEN y IS NULL THEN 1.0::DOUBLE ELSE 1 / (1 / 2.0::DOUBLE + 1) END AS v FROM k WHERE t = 0
  UNION ALL
  SELECT k.trial, k.var, k.t, CASE WHEN k.y IS NULL THEN 0.9 * mu ELSE 0.9 * mu + 1 / (1 / 2.0::DOUBLE + 1 / (0.81 * v + 0.5)) * (k.y - 0.2 - 0.9 * mu) / 2.0 END,
    CASE WHEN k.y IS NULL THEN 0.81 * v + 0.5 ELSE 1 / (1 / 2.0::DOUBLE + 1 / (0.81 * v + 0.5)) END
  FROM fl JOIN k ON k.trial = fl.trial AND k.var = fl.var AND k.t = fl.t + 1)"""


@query("kalman_filter_scalar", f"WITH RECURSIVE {FILTER} SELECT trial, var, t, round(mu, 6) + 0.0 AS mu, round(v, 6) AS v FROM fl")
def kalman_filter_scalar(spark, sf):
    return rounded(kalman.scalar_filter(masked_counts(spark, sf), **SCALAR))


@query("em_suffstats_scalar", f"""WITH RECURSIVE {FILTER} SELECT var, count(*) AS n, round(sum(y), 6) AS sy, round(sum(y * y), 6) AS syy, round(sum(mu), 6) AS sx, round(sum(mu * mu + v), 6) AS sxx, round(sum(y * mu), 6) AS syx
FROM k JOIN fl USING (trial, var, t) WHERE y IS NOT NULL GROUP BY var""")
def em_suffstats_scalar(spark, sf):
    y = masked_counts(spark, sf)
    return rounded(kalman.suffstats(y, kalman.scalar_filter(y, **SCALAR)))


def _start(spark, sf, n=2):
    y, p = masked_counts(spark, sf), kinds(spark, sf)
    got = {r["var"]: r for r in y.groupBy("var").agg(F.avg("y").alias("m"), F.var_pop("y").alias("v")).collect()}  # one row a variable
    value = lambda c: np.array([got[i][c] if i in got and got[i][c] is not None else 0.0 for i in range(p)])
    return lagcov.packed(y, p, every_step=True), fitting.start_model(n, value("m"), value("v"))


@query("kalman_smoother")
def kalman_smoother(spark, sf):
    rows, model = _start(spark, sf)
    return kalman.posterior(rows, model)


@query("em_fit")
def em_fit(spark, sf):
    """Log-likelihood by round of expectation maximisation."""
    rows, model = _start(spark, sf)
    _, trace = fitting.fit(rows, model, rounds=5)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(trace)], "round int, loglik double")


@query("ssid_svd")
def ssid_svd(spark, sf):
    """Model lag covariances next to the measured ones, from subspace identification."""
    p = kinds(spark, sf)
    q = lagcov.lag_cov(counts(spark, sf), p, 4)
    a, c, pi, r = fitting.subspace(fitting.dense(q, 4, p), 2, 2)
    made = [(m, i, j, float((c @ np.linalg.matrix_power(a, m) @ pi @ c.T)[i, j] + (r[i] if m == 0 and i == j else 0.0))) for m in range(4) for i in range(p) for j in range(p)]
    return q.join(spark.createDataFrame(made, "m int, i int, j int, model double"), ["m", "i", "j"])


@query("scale_lookup", """WITH c AS (SELECT user_id, ts, max(value) AS last_click FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT v.event_id, v.user_id, c.last_click FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN c ON v.user_id = c.user_id AND v.ts >= c.ts""")
def scale_lookup(spark, sf):
    """The value of each user's last click at the time of a view."""
    events = panels.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return asof.as_of(views, events.where("event_type = 'click'").select("user_id", "ts", "value"), ["user_id"], "ts", "value", "last_click").drop("ts")


@query("segment_bounds", f"WITH {SCHEME} SELECT seg, lag(t_end, 1, 0) OVER (ORDER BY seg) AS t_start, t_end, t_end - lag(t_end, 1, 0) OVER (ORDER BY seg) AS step FROM sc")
def segment_bounds(spark, sf):
    return asof.segment_bounds(panels.schedule(panels.vectors(spark, sf)).select("seg", "t_end"))


@query("cov_two_lag", f"WITH {COUNTS}, x AS (SELECT var, y, lead(y) OVER (PARTITION BY trial, var ORDER BY t) AS z FROM y) SELECT var, round(covar_samp(y, z), 6) + 0.0 AS cov FROM x WHERE z IS NOT NULL GROUP BY var")
def cov_two_lag(spark, sf):
    rows = panel.lag_lead(counts(spark, sf)).where("y_next IS NOT NULL")
    return rounded(rows.groupBy("var").agg(F.covar_samp("y", "y_next").alias("cov")))


#: Dependencies between event types: one type follows another (dt -1) or shares a user's hour with it (dt 0).
DEP = """
s AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, epoch_us(ts) // 3600000000 AS h FROM events),
dep AS (SELECT DISTINCT prev AS parent, event_type AS child, -1 AS dt FROM s WHERE prev IS NOT NULL AND prev <> event_type
  UNION ALL SELECT DISTINCT a.event_type, b.event_type, 0 FROM (SELECT DISTINCT user_id, h, event_type FROM s) a JOIN (SELECT DISTINCT user_id, h, event_type FROM s) b USING (user_id, h) WHERE a.event_type < b.event_type)"""


def dependencies(spark, sf):
    events = panels.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select("user_id", F.col("event_type").alias("child"), F.lag("event_type").over(order).alias("parent"))
    before = rows.where("parent IS NOT NULL AND parent <> child").select("parent", "child").distinct().withColumn("dt", F.lit(-1))
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    kinds = events.groupBy("user_id", hour.alias("h")).agg(F.sort_array(F.collect_set("event_type")).alias("k"))  # at most one of each type
    pairs = kinds.select("k", F.posexplode("k").alias("i", "parent")).select("parent", F.explode(F.expr("slice(k, i + 2, size(k))")).alias("child"))
    return before.unionByName(pairs.distinct().withColumn("dt", F.lit(0)))


@query("dependencies", f"WITH {DEP} SELECT parent, child, dt FROM dep")
def dependency_table(spark, sf):
    return dependencies(spark, sf)


@query("conditionals", f"WITH {DEP} SELECT child, string_agg(dt || ':' || parent, ',' ORDER BY dt, parent) AS parents FROM dep GROUP BY child")
def conditionals(spark, sf):
    return graphs.conditionals(dependencies(spark, sf))


@query("time_scope", f"WITH {DEP} SELECT DISTINCT dt FROM dep")
def time_scope(spark, sf):
    return graphs.time_scope(dependencies(spark, sf))


@query("model_flags", f"WITH {DEP} SELECT max(dt) <= 0 AS causal, count(*) FILTER (dt = 0) AS n_instant FROM dep")
def model_flags(spark, sf):
    return graphs.flags(dependencies(spark, sf))


@query("initial_subgroups", f"WITH {DEP} SELECT DISTINCT parent FROM dep WHERE dt < 0")
def initial_subgroups(spark, sf):
    return graphs.initial(dependencies(spark, sf))


@query("sampling_order", f"""WITH RECURSIVE {DEP}, nd AS (SELECT parent AS node FROM dep UNION SELECT child FROM dep),
w AS (SELECT node, 0 AS g FROM nd UNION SELECT child, g + 1 FROM w JOIN dep ON parent = node AND dt = 0) SELECT node, CAST(max(g) AS INTEGER) AS generation FROM w GROUP BY node""")
def sampling_order(spark, sf):
    return graphs.sampling_order(dependencies(spark, sf))


@query("cyclic_check", f"""WITH RECURSIVE {DEP}, e2 AS (SELECT parent, child FROM dep),
w AS (SELECT parent, child FROM e2 UNION SELECT w.parent, e2.child FROM w JOIN e2 ON w.child = e2.parent) SELECT parent AS node FROM w WHERE parent = child""")
def cyclic_check(spark, sf):
    """Event types that lead back to themselves over any dependencies, each taken as instantaneous."""
    return graphs.own_ancestors(dependencies(spark, sf).withColumn("dt", F.lit(0)))


@query("var_dims", f"WITH {VECTORS} SELECT experiment, count(DISTINCT var) AS n_var, CAST(min(var) AS INTEGER) AS first_var, CAST(max(var) AS INTEGER) AS last_var FROM e GROUP BY experiment")
def var_dims(spark, sf):
    return panels.vectors(spark, sf).groupBy("experiment").agg(F.countDistinct("var").alias("n_var"), F.min("var").alias("first_var"), F.max("var").alias("last_var"))


@query("subgroup_sizes", f"WITH {SCHEME} SELECT pop_id, count(*) AS n, string_agg(var, ',' ORDER BY var) AS vars FROM sp GROUP BY pop_id")
def subgroup_sizes(spark, sf):
    names = F.array_join(F.transform(F.sort_array(F.collect_list("var")), lambda v: v.cast("string")), ",")
    return _pops(spark, sf).groupBy("pop_id").agg(F.count("*").alias("n"), names.alias("vars"))


@query("prior_mean_scalar", f"WITH {COUNTS}, a AS (SELECT var, avg(y) AS m FROM y GROUP BY var) SELECT var, CAST(t AS INTEGER) AS t, round(m * pow(0.9, t), 6) AS mean FROM a CROSS JOIN range(24) r(t)")
def prior_mean_scalar(spark, sf):
    rows = counts(spark, sf).groupBy("var").agg(F.avg("y").alias("m"))
    return rounded(rows.select("var", "m", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("t")).select("var", "t", (F.col("m") * F.pow(F.lit(0.9), F.col("t"))).alias("mean")))


@query("predict_rate_scalar", f"WITH RECURSIVE {FILTER} SELECT trial, var, round(exp(least(0.1 * 0.9 * mu + 0.2 + 0.5 * 0.01 * (0.81 * v + 0.5), 50)), 6) AS rate FROM fl WHERE t = 23")
def predict_rate_scalar(spark, sf):
    """Expected count one step after the last, with loading 0.1 and offset 0.2 on the log rate."""
    last = kalman.scalar_filter(masked_counts(spark, sf), **SCALAR).where(F.col("t") == HOURS - 1)
    drive = 0.1 * 0.9 * F.col("mu") + 0.2 + 0.5 * 0.01 * (0.81 * F.col("v") + 0.5)
    return rounded(last.select("trial", "var", F.exp(F.least(drive, F.lit(50.0))).alias("rate")))


@query("hankel_loss", f"""WITH {LINEAR} SELECT m, round(avg((q - e) * (q - e)) / 4, 6) + 0.0 AS loss FROM (SELECT q.*, CASE WHEN i = j THEN pow(0.5, m) ELSE 0 END AS e FROM q) GROUP BY m""")
def hankel_loss(spark, sf):
    """Mean squared distance of each lag's covariances from those of independent first-order series, over k l = 4."""
    model = F.when(F.col("i") == F.col("j"), F.pow(F.lit(0.5), F.col("m"))).otherwise(F.lit(0.0))
    return rounded(linear(spark, sf).groupBy("m").agg((F.avg((F.col("q") - model) ** 2) / 4).alias("loss")))


@query("sign_flip_check", f"WITH {LINEAR} SELECT m, sum(CASE WHEN q < 0 THEN 1 ELSE 0 END) > 0.5 * count(*) AS flipped FROM q GROUP BY m")
def sign_flip_check(spark, sf):
    return linear(spark, sf).groupBy("m").agg((F.count_if(F.col("q") < 0) > 0.5 * F.count("*")).alias("flipped"))


def _poisson_start(spark, sf, n=2):
    y, p = masked_counts(spark, sf), kinds(spark, sf)
    got = {r["var"]: r["m"] for r in y.groupBy("var").agg(F.avg("y").alias("m")).collect()}  # one row a variable
    level = np.log(np.maximum([got.get(i) or 0.0 for i in range(p)], 1e-2))
    rng = np.random.default_rng(0)
    return lagcov.packed(y, p, every_step=True), kalman.Model(0.8 * np.eye(n), 0.36 * np.eye(n), np.zeros(n), np.eye(n), 0.1 * rng.standard_normal((p, n)), level, np.ones(p))


@query("laplace_inference")
def laplace_inference(spark, sf):
    rows, model = _poisson_start(spark, sf)
    return poisson.posterior(rows, model)


@query("plds_em")
def plds_em(spark, sf):
    """Approximate evidence by round of Laplace EM."""
    rows, model = _poisson_start(spark, sf)
    _, trace = poisson.fit(rows, model, rounds=4)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(trace)], "round int, bound double")


@query("predict_range")
def predict_range(spark, sf):
    rows, model = _poisson_start(spark, sf)
    return poisson.predict(rows, model, (0, 18), (18, 24))


@query("plds_sample")
def plds_sample(spark, sf):
    """A simulated day for every day of events, at the measured rates."""
    _, model = _poisson_start(spark, sf)
    return poisson.sample(counts(spark, sf).select("trial").distinct(), model, HOURS)


@query("iter_ssid")
def iter_ssid(spark, sf):
    """Lag covariances of a stitched panel: pairs never seen together are filled in by the model."""
    seen = counts(spark, sf).withColumn("y", F.when(((F.col("trial") % 2 == 0) & (F.col("var") <= 2)) | ((F.col("trial") % 2 == 1) & (F.col("var") >= 2)), F.col("y").cast("double")))
    p = kinds(spark, sf)
    q = lagcov.lag_cov(seen, p, 4)
    full, trace = stitching.fill(fitting.dense(q, 4, p), stitching.observed(q, 4, p), 2, 2)
    rows = [(m, i, j, float(full[m, i, j])) for m, i, j in np.ndindex(*full.shape)]
    out = spark.createDataFrame(rows, "m int, i int, j int, filled double")
    return out.join(q, ["m", "i", "j"], "left").select("m", "i", "j", "filled", "q")


STREAM = "w AS (SELECT event_type, epoch_us(ts) // 3600000000 AS h FROM events), n AS (SELECT event_type, h, count(*) AS n FROM w WHERE (h + 1) * 3600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 7200000000 FROM events) GROUP BY ALL)"


@query("online_filter", f"""WITH RECURSIVE {STREAM}, b AS (SELECT event_type, min(h) AS lo, max(h) AS hi FROM n GROUP BY event_type),
k AS (SELECT event_type, x.h, n.n, lo, hi FROM (SELECT event_type, lo, hi, unnest(range(lo, hi + 1)) AS h FROM b) x LEFT JOIN n USING (event_type, h)),
o AS (
  SELECT event_type, h, hi, n, (1 / (1 / 2.0::DOUBLE + 1)) * (n - 0.2) / 2.0 AS mu, 1 / (1 / 2.0::DOUBLE + 1) AS v FROM k WHERE h = lo
  UNION ALL
  SELECT k.event_type, k.h, k.hi, k.n, CASE WHEN k.n IS NULL THEN 0.9 * mu ELSE 0.9 * mu + 1 / (1 / 2.0::DOUBLE + 1 / (0.81 * v + 0.5)) * (k.n - 0.2 - 0.9 * mu) / 2.0 END,
    CASE WHEN k.n IS NULL THEN 0.81 * v + 0.5 ELSE 1 / (1 / 2.0::DOUBLE + 1 / (0.81 * v + 0.5)) END
  FROM o JOIN k ON k.event_type = o.event_type AND k.h = o.h + 1)
SELECT event_type, h, round(mu, 6) + 0.0 AS mu, round(v, 6) AS v FROM o WHERE n IS NOT NULL""")
def online_filter(spark, sf):
    """Filtered level of every event type's hourly counts, from a stream of events."""
    return rounded(online.filtered_counts(spark, sf, **{k: v for k, v in SCALAR.items()}))


@query("stream_counts", """WITH w AS (SELECT event_type, epoch_us(ts) // 3600000000 AS h FROM events)
SELECT event_type, h, count(*) AS n FROM w WHERE (h + 1) * 3600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 7200000000 FROM events) GROUP BY ALL""")
def stream_counts(spark, sf):
    """Hourly counts by event type from a stream, for the hours that the watermark (two hours) has closed."""
    return online.closed_counts(spark, sf)


@query("mini_batch_trials", f"WITH {COUNTS}, b AS (SELECT trial FROM (SELECT DISTINCT trial FROM y) ORDER BY md5(trial || ':7') LIMIT 10) SELECT trial, var, t, y FROM y WHERE trial IN (SELECT trial FROM b)")
def mini_batch_trials(spark, sf):
    return sampling.mini_batch(counts(spark, sf), 10, 7)


@query("sample_vars", f"WITH {VECTORS} SELECT var FROM (SELECT DISTINCT var FROM e) ORDER BY md5(var || ':3') LIMIT 20")
def sample_vars(spark, sf):
    return sampling.sample_vars(panels.vectors(spark, sf), 20, 3)


@query("random_perm", f"WITH {COUNTS} SELECT trial, t, CAST(row_number() OVER (PARTITION BY trial ORDER BY md5(trial || ':' || t || ':5')) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT trial, t FROM y)")
def random_perm(spark, sf):
    return sampling.random_order(counts(spark, sf), 5)


@query("mstep_stats", f"""WITH {COUNTS}, x AS (SELECT var, CAST(y AS DOUBLE) AS y, CAST(lead(y) OVER (PARTITION BY trial, var ORDER BY t) AS DOUBLE) AS z FROM y)
SELECT var, sum(y * y) AS s00, sum(y * z) AS s01, sum(z * z) AS s11, count(*) AS n FROM x WHERE z IS NOT NULL GROUP BY var""")
def mstep_stats(spark, sf):
    return regression.step_sums(counts(spark, sf))


@query("lds_observed", f"""WITH {COUNTS}, x AS (SELECT var, CAST(y AS DOUBLE) AS y, CAST(lead(y) OVER (PARTITION BY trial, var ORDER BY t) AS DOUBLE) AS z FROM y),
s AS (SELECT var, sum(y * y) AS s00, sum(y * z) AS s01, sum(z * z) AS s11, count(*) AS n FROM x WHERE z IS NOT NULL GROUP BY var)
SELECT var, round(s01 / s00, 6) AS a, round((s11 - s01 / s00 * s01) / n, 6) AS q FROM s WHERE s00 > 0""")
def lds_observed(spark, sf):
    return rounded(regression.observed_dynamics(counts(spark, sf)))


@query("affine_link", f"""WITH {COUNTS} SELECT trial, t, CAST(o AS INTEGER) AS out, round(sum(y * (var - 2.0::DOUBLE) * (o + 1)) + any_value(o), 6) + 0.0 AS y FROM y CROSS JOIN range(3) r(o) GROUP BY trial, t, o""")
def affine_link(spark, sf):
    """Three readouts of the counts, with weights that rise with the variable's number."""
    y = counts(spark, sf)
    grid = y.select("var").distinct().select("var", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("out"))
    weights = grid.select("var", "out", ((F.col("var") - 2.0) * (F.col("out") + 1)).alias("w"))
    return rounded(regression.affine(y, weights, grid.select("out", F.col("out").cast("double").alias("b")).distinct()))


@query("noise_interaction", f"WITH {COUNTS}, p AS (SELECT var, t, avg(y) AS rate FROM y GROUP BY ALL) SELECT trial, var, t, round(y - rate, 6) + 0.0 AS added, round(y * rate, 6) AS scaled, round(pow(rate, 2), 6) AS powered FROM y JOIN p USING (var, t)")
def noise_interaction(spark, sf):
    """A mean and a deviation combined by sum, product and power."""
    y = counts(spark, sf)
    rows = y.join(panel.psth(y).select("var", "t", "rate"), ["var", "t"])
    return rounded(rows.select("trial", "var", "t", (F.col("y") - F.col("rate")).alias("added"), (F.col("y") * F.col("rate")).alias("scaled"), F.pow("rate", F.lit(2.0)).alias("powered")))


@query("poisson_mixture", f"""WITH {COUNTS}, p AS (SELECT var, t, avg(y) + 0.1 AS rate FROM y GROUP BY ALL)
SELECT trial, var, round(sum(0.7 * (-y * ln(rate) + rate) + 0.3 * (-y * ln(2 * rate) + 2 * rate)), 6) AS like_, round(sum(0.7 * rate * (ln(rate / 0.7) - 1)), 6) AS dual FROM y JOIN p USING (var, t) GROUP BY ALL""")
def poisson_mixture(spark, sf):
    """Mixture-weighted likelihood (two levels, 0.7 and 0.3) and its conjugate."""
    y = counts(spark, sf)
    rows = y.join(panel.psth(y).select("var", "t", (F.col("rate") + 0.1).alias("rate")), ["var", "t"])
    level = lambda k: L.poisson_like(F.col("y"), F.ln(k * F.col("rate")), F.lit(0.0))
    return rounded(rows.groupBy("trial", "var").agg(F.sum(0.7 * level(1.0) + 0.3 * level(2.0)).alias("like_"), F.sum(L.mixture_dual(F.col("rate"), 0.7)).alias("dual")))


@query("ingest_spikes", f"""WITH {SPIKES}, k AS (SELECT var FROM sk GROUP BY var HAVING count(*) / (SELECT (max(trial) - min(trial) + 1) * 24.0 FROM sk) >= 1.0)
SELECT trial, var, CAST(floor(ts / 6) AS INTEGER) AS t, count(*) AS y, round(sum(value), 4) AS total FROM sk WHERE var IN (SELECT var FROM k) GROUP BY ALL""")
def ingest_spikes(spark, sf):
    """Spikes of cells above a rate, in six-hour bins, with their summed values."""
    s = panels.spikes(spark, sf)
    kept = s.join(panel.rates(s, _hours(s), 1.0).select("var"), "var", "left_semi")
    return kept.groupBy("trial", "var", F.floor(F.col("ts") / 6).cast("int").alias("t")).agg(F.count("*").alias("y"), F.round(F.sum("value"), 4).alias("total"))


@query("traces_any", f"""WITH {COUNTS}, {VECTORS} SELECT 'y' AS grp, trial, var, t, CAST(y AS DOUBLE) AS y FROM y WHERE t < 3 AND var IN (0, 1) UNION ALL SELECT 'u', 0, var, t, round(y, 6) + 0.0 FROM e WHERE t < 3 AND var IN (0, 1)""")
def traces_any(spark, sf):
    """Slices of outputs and inputs, stacked."""
    y = counts(spark, sf).select(F.lit("y").alias("grp"), "trial", "var", "t", F.col("y").cast("double").alias("y"))
    u = panels.vectors(spark, sf).select(F.lit("u").alias("grp"), F.lit(0).alias("trial"), "var", "t", "y")
    return rounded(panel.traces(y.unionByName(u), var=[0, 1], t=[0, 1, 2]))


@query("daily_series", """WITH o AS (SELECT l_returnflag || l_linestatus AS series, CAST(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS INTEGER) AS day, l_quantity FROM lineitem)
SELECT series, day // 7 AS t, count(*) AS n, sum(l_quantity) AS quantity, round(avg(l_quantity), 6) AS mean FROM o GROUP BY ALL""")
def daily_series(spark, sf):
    """lineitem as weekly series by flag and status."""
    day = F.expr("CAST(timestampdiff(DAY, TIMESTAMP_NTZ '1992-01-01 00:00:00', l_shipdate) AS INT)")
    rows = panels.table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("series"), F.floor(day / 7).cast("int").alias("t"), "l_quantity")
    return rounded(rows.groupBy("series", "t").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.avg("l_quantity").alias("mean")))


@query("membership", """SELECT r_name AS pop, n_name AS var, count(c_custkey) AS n_customers, dense_rank() OVER (ORDER BY r_name) - 1 AS pop_id FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name""")
def membership(spark, sf):
    """Nations as variables of the populations that regions are, with the customers of each."""
    t = lambda name: panels.table(spark, sf, name)
    held = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("n_customers"))
    rows = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(held, "n_nationkey", "left")
    rank = F.dense_rank().over(W.orderBy("r_name")) - 1  # one row a nation
    return rows.select(F.col("r_name").alias("pop"), F.col("n_name").alias("var"), F.coalesce("n_customers", F.lit(0)).cast("long").alias("n_customers"), rank.cast("long").alias("pop_id"))
