"""Lagged cross-covariances, co-observation counts and Hankel layouts.

Cells are packed into one array a time step, joined with the step m before, and multiplied by numpy inside the
tasks, which pass on one p x p sum each: the shuffle carries tasks x p^2 rows instead of T x p^2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import stored


def nan_mean(panel: DataFrame) -> DataFrame:
    """(var, mean, n) over observed cells; nulls and NaN are not observed."""
    y = F.nanvl("y", F.lit(None).cast("double"))
    return panel.groupBy("var").agg(F.avg(y).alias("mean"), F.count(y).alias("n"))


def packed(panel: DataFrame, n_vars: int, *, every_step: bool = False) -> DataFrame:
    """(trial, t, y array) with null for cells that aren't observed.

    Steps without any observed cell have no row, unless every_step asks for all steps between a trial's first and last one.
    """
    rows = panel.where(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")))
    cells = rows.groupBy("trial", "t").agg(F.map_from_entries(F.collect_list(F.struct("var", F.col("y").cast("double").alias("y")))).alias("m"))
    if every_step:
        cells = every(panel.groupBy("trial").agg(F.min("t").alias("a"), F.max("t").alias("b"))).join(cells, ["trial", "t"], "left")
    return cells.select("trial", "t", F.transform(F.sequence(F.lit(0), F.lit(n_vars - 1)), lambda v: F.element_at("m", v)).alias("y"))


def every(spans: DataFrame, block: int = 10_000) -> DataFrame:
    """(trial, t) for each step from a to b of spans (trial, a, b), by arrays of at most ``block`` steps and one of their number.

    A span of more than block^2 steps takes as many arrays of the second kind as it needs.
    """
    far = lambda first, last, step: F.explode(F.sequence(first, last, F.lit(step).cast("long")))
    rows = spans.select("trial", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    for step in (block * block, block):
        rows = rows.select("trial", far(F.col("a"), F.col("b"), step).alias("a"), "b").withColumn("b", F.least("b", F.col("a") + step - 1))
    return rows.select("trial", far(F.col("a"), F.col("b"), 1).alias("t")).withColumn("t", F.col("t").cast("int"))


def _means(rows: DataFrame, n_vars: int) -> np.ndarray:
    """Means over the observed cells of packed rows; NaN where there are none. One row a variable is collected."""
    out = np.full(n_vars, np.nan)
    for r in rows.select(F.posexplode("y").alias("var", "y")).groupBy("var").agg(F.avg("y").alias("mean")).collect():
        out[r["var"]] = np.nan if r["mean"] is None else r["mean"]
    return out


def _products(pairs: DataFrame, means: np.ndarray) -> DataFrame:
    """(m, i, j, s, n): sums of centred products of now and before, and how many there were."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[np.ndarray]] = {}
        for frame in frames:
            for m, rows in frame.groupby("m"):
                a, b = (np.array([np.asarray(x, float) for x in rows[c]]) - means for c in ("now", "before"))
                on_a, on_b = np.isfinite(a), np.isfinite(b)
                s, n = np.where(on_a, a, 0).T @ np.where(on_b, b, 0), on_a.T.astype(float) @ on_b
                old = sums.get(m)
                sums[m] = [s, n] if old is None else [old[0] + s, old[1] + n]
        for m, (s, n) in sums.items():
            i, j = np.nonzero(n)
            yield pd.DataFrame({"m": m, "i": i, "j": j, "s": s[i, j], "n": n[i, j].astype(int)})

    made = pairs.select("m", "now", "before").mapInPandas(add, "m int, i int, j int, s double, n long")
    return made.groupBy("m", "i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def lagged(rows: DataFrame, lags: int, length: int | None = None) -> DataFrame:
    """(trial, t, m, now, before): each packed row next to the one m steps before, for m < lags; time wraps at ``length``."""
    now = rows.select("trial", "t", F.col("y").alias("now"), F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("m"))
    back = F.col("t") - F.col("m") if length is None else F.pmod(F.col("t") - F.col("m"), F.lit(length))
    return now.withColumn("u", back).join(rows.select("trial", F.col("t").alias("u"), F.col("y").alias("before")), ["trial", "u"])


def lag_sums(panel: DataFrame, n_vars: int, lags: int, *, length: int | None = None) -> DataFrame:
    """(m, i, j, s, n) for m < lags: sums of (y_i(t) - mean_i)(y_j(t - m) - mean_j) within trials, not divided by anything.

    With a length time wraps there. The packed panel is stored once.
    """
    rows = stored(packed(panel, n_vars))
    return _products(lagged(rows, lags, length), _means(rows, n_vars))


def lag_cov(panel: DataFrame, n_vars: int, lags: int, *, circular: bool = False, length: int | None = None) -> DataFrame:
    """(m, i, j, q, n) for m < lags: mean of (y_i(t) - mean_i)(y_j(t - m) - mean_j) within trials.

    Linear: over the n products there are. Circular (needs length): time wraps and sums are divided by the
    co-observation count of lag 0; pairs never seen together have no row.
    """
    sums = lag_sums(panel, n_vars, lags, length=length if circular else None)
    if not circular:
        return sums.select("m", "i", "j", (F.col("s") / F.col("n")).alias("q"), "n")
    sums = stored(sums)
    n0 = sums.where("m = 0").select("i", "j", F.col("n").alias("n0"))
    return sums.join(n0, ["i", "j"]).select("m", "i", "j", (F.col("s") / F.col("n0")).alias("q"), F.col("n0").alias("n"))


def window_cov(panel: DataFrame, n_vars: int, k: int) -> DataFrame:
    """(r, c, i, j, q): covariances of future and past blocks of k steps, over all full windows of 2 k steps of all trials.

    Series are centred within their trials; trials of at most two windows don't count. Block (r, c) pairs step k + r of a
    window with step k - 1 - c. Each pair's sum is divided by the products that were seen, which without unseen cells is the number of
    windows; pairs without any have no row. A trial's steps begin at 0.
    """
    centred = panel.join(panel.groupBy("trial", "var").agg(F.avg("y").alias("mean")), ["trial", "var"])
    rows = stored(packed(centred.select("trial", "var", "t", (F.col("y") - F.col("mean")).alias("y")), n_vars))
    trials = rows.groupBy("trial").agg((F.max("t") + 2 - 2 * k).alias("windows")).where("windows > 2")
    blocks = [F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(k) for c in range(k)]
    now = rows.join(trials, "trial").select("trial", "t", "windows", F.col("y").alias("now"), F.explode(F.array(*blocks)).alias("x"))
    now = now.where(F.col("t").between(k + F.col("x.r"), k - 1 + F.col("x.r") + F.col("windows")))
    now = now.select("trial", (F.col("x.r") * k + F.col("x.c")).alias("m"), (F.col("t") - F.col("x.r") - F.col("x.c") - 1).alias("u"), "now")
    sums = _products(now.join(rows.select("trial", F.col("t").alias("u"), F.col("y").alias("before")), ["trial", "u"]), np.zeros(n_vars))
    return sums.select(F.floor(F.col("m") / k).cast("int").alias("r"), (F.col("m") % k).alias("c"), "i", "j", (F.col("s") / F.col("n")).alias("q"))


def sample_cov(panel: DataFrame, n_vars: int, k: int, l: int) -> DataFrame:  # noqa: E741
    """(m, i, j, q) for m < k + l: sample covariance of y_i(t + m) and y_j(t) over the same steps t for every lag.

    These are all steps of a trial but its last k + l. A constant as one more variable gives the sums that centre each lag's own
    steps, so a panel with unseen cells or steps is refused: its lags would have different steps.
    """
    gaps = panel.groupBy("trial").agg((F.count("y") - (F.max("t") - F.min("t") + 1).cast("long") * n_vars).alias("gaps")).where("gaps <> 0")
    if not gaps.isEmpty():
        raise ValueError("sample covariances need every cell of every step")
    rows = packed(panel, n_vars).select("trial", "t", F.concat("y", F.array(F.lit(1.0))).alias("y"))
    rows = stored(rows.join(panel.groupBy("trial").agg((F.max("t") - k - l).alias("last")), "trial"))
    pairs = lagged(rows.select("trial", "t", "y"), k + l).join(rows.select("trial", "last").distinct(), "trial").where(F.col("t") - F.col("m") <= F.col("last"))
    sums = stored(_products(pairs, np.zeros(n_vars + 1)))
    left = sums.where((F.col("j") == n_vars) & (F.col("i") < n_vars)).select("m", "i", F.col("s").alias("si"))
    right = sums.where((F.col("i") == n_vars) & (F.col("j") < n_vars)).select("m", "j", F.col("s").alias("sj"))
    both = sums.where((F.col("i") < n_vars) & (F.col("j") < n_vars)).join(left, ["m", "i"]).join(right, ["m", "j"])
    return both.select("m", "i", "j", ((F.col("s") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("q"))


def coobs_count(panel: DataFrame, n_vars: int) -> DataFrame:
    """(i, j, n): time steps at which both variables are observed."""
    rows = packed(panel, n_vars).select(F.lit(0).alias("m"), F.col("y").alias("now"), F.col("y").alias("before"))
    return _products(rows, np.zeros(n_vars)).select("i", "j", "n")


def hankel(lagcov: DataFrame, k: int, l: int) -> DataFrame:  # noqa: E741
    """(r, c, i, j, q): block (r, c) is lag r + c + 1."""
    blocks = F.explode(F.sequence(F.greatest(F.lit(0), F.col("m") - l), F.least(F.lit(k - 1), F.col("m") - 1)))
    rows = lagcov.where((F.col("m") >= 1) & (F.col("m") <= k + l - 1)).select("m", "i", "j", "q", blocks.alias("r"))
    return rows.select("r", (F.col("m") - 1 - F.col("r")).cast("int").alias("c"), "i", "j", "q")


def symmetrized(lagcov: DataFrame) -> DataFrame:
    """(A + A') / 2 of each lag."""
    other = lagcov.select("m", F.col("j").alias("i"), F.col("i").alias("j"), F.col("q").alias("p"))
    return lagcov.join(other, ["m", "i", "j"]).select("m", "i", "j", ((F.col("q") + F.col("p")) / 2).alias("q"))


def autocorr(panel: DataFrame, n_vars: int, lags: int) -> DataFrame:
    """(var, m, acf): sums of lagged products over the sum of squares, within trials."""
    sums = stored(lag_sums(panel, n_vars, lags).where("i = j"))
    zero = sums.where("m = 0").select("i", F.col("s").alias("s0"))
    return sums.join(zero, "i").select(F.col("i").alias("var"), "m", (F.col("s") / F.col("s0")).alias("acf"))


def acf_bounds(acf: DataFrame, panel: DataFrame, n_ma: int = 0, n_std: float = 2.0) -> DataFrame:
    """(var, lower, upper): where an autocorrelation beyond lag n_ma is no sign of anything, by Bartlett's variance."""
    early = acf.where(F.col("m").between(1, n_ma)).groupBy("var").agg(F.sum(F.col("acf") ** 2).alias("squares"))
    rows = panel.groupBy("var").agg(F.count("y").alias("n")).join(early, "var", "left")
    edge = n_std * F.sqrt((1 + 2 * F.coalesce("squares", F.lit(0.0))) / F.col("n"))
    return rows.select("var", (-edge).alias("lower"), edge.alias("upper"))


def model_cov(loadings: DataFrame, inner: DataFrame, noise: DataFrame) -> DataFrame:
    """(m, i, j, q): C A^m Pi C' + R at lag 0, from loadings (var, k, w), inner = A^m Pi (m, k, l, w) and noise (var, r)."""
    left = loadings.select(F.col("var").alias("i"), "k", F.col("w").alias("wi"))
    right = loadings.select(F.col("var").alias("j"), F.col("k").alias("l"), F.col("w").alias("wj"))
    rows = inner.join(left, "k").groupBy("m", "i", "l").agg(F.sum(F.col("w") * F.col("wi")).alias("x"))
    q = rows.join(right, "l").groupBy("m", "i", "j").agg(F.sum(F.col("x") * F.col("wj")).alias("q"))
    own = noise.select(F.lit(0).alias("m"), F.col("var").alias("i"), F.col("var").alias("j"), "r")
    return q.join(own, ["m", "i", "j"], "left").select("m", "i", "j", (F.col("q") + F.coalesce("r", F.lit(0.0))).alias("q"))


def hankel_loss(measured: DataFrame, modelled: DataFrame, mask: DataFrame) -> DataFrame:
    """(m, loss, n): half the mean squared difference of two lag covariances over the pairs (i, j) of a mask."""
    rows = measured.select("m", "i", "j", F.col("q").alias("x")).join(modelled.select("m", "i", "j", F.col("q").alias("y")), ["m", "i", "j"])
    rows = rows.join(mask.select("i", "j").distinct(), ["i", "j"])
    return rows.groupBy("m").agg((F.avg((F.col("x") - F.col("y")) ** 2) / 2).alias("loss"), F.count("*").alias("n"))


def loading_gradient(measured: DataFrame, modelled: DataFrame, mask: DataFrame, loadings: DataFrame, inner: DataFrame) -> DataFrame:
    """(var, k, g): derivative by the loadings of the sum over lags of squared differences / 2 over the pairs of a mask.

    With residual e = C A^m Pi C' - q at (i, j), row i gets e (A^m Pi C'_j) and row j gets e (C_i A^m Pi).
    """
    e = measured.select("m", "i", "j", F.col("q").alias("x")).join(modelled.select("m", "i", "j", F.col("q").alias("y")), ["m", "i", "j"]).join(mask.select("i", "j").distinct(), ["i", "j"])
    e = e.select("m", "i", "j", (F.col("y") - F.col("x")).alias("e"))
    right = inner.join(loadings.select(F.col("var").alias("j"), F.col("k").alias("l"), F.col("w").alias("wj")), "l").groupBy("m", "j", "k").agg(F.sum(F.col("w") * F.col("wj")).alias("z"))
    left = inner.join(loadings.select(F.col("var").alias("i"), "k", F.col("w").alias("wi")), "k").groupBy("m", "i", F.col("l").alias("k")).agg(F.sum(F.col("w") * F.col("wi")).alias("z"))
    one = e.join(right, ["m", "j"]).select(F.col("i").alias("var"), "k", (F.col("e") * F.col("z")).alias("g"))
    two = e.join(left, ["m", "i"]).select(F.col("j").alias("var"), "k", (F.col("e") * F.col("z")).alias("g"))
    return one.unionByName(two).groupBy("var", "k").agg(F.sum("g").alias("g"))


def pair_scores(a: DataFrame, b: DataFrame, mask: DataFrame) -> DataFrame:
    """Correlation and mean squared error of two lag covariances, apart for pairs in mask (i, j) and others."""
    rows = a.select("m", "i", "j", F.col("q").alias("x")).join(b.select("m", "i", "j", F.col("q").alias("y")), ["m", "i", "j"])
    rows = rows.join(mask.select("i", "j", F.lit(True).alias("seen")), ["i", "j"], "left").withColumn("observed", F.coalesce("seen", F.lit(False)))
    return rows.groupBy("m", "observed").agg(F.corr("x", "y").alias("corr"), F.avg((F.col("x") - F.col("y")) ** 2).alias("mse"), F.count("*").alias("n"))
