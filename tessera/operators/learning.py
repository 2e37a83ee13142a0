"""Sums that the maximisation steps need, by variable and by group of variables, and Poisson regression.

Latent means come as long tables (trial, t, k, x), their covariances as (trial, t, k, l, v), inputs as
(trial, t, k, u). Everything is joined by (trial, t) and summed by Spark; what is left has the size of the parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.store import stored


def regressors(states: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """(trial, t, f, z): states as x0, x1, ..., inputs as u0, u1, ..., and 1 for the offset."""
    rows = states.select("trial", "t", F.concat(F.lit("x"), F.col("k")).alias("f"), F.col("x").alias("z"))
    if inputs is not None:
        rows = rows.unionByName(inputs.select("trial", "t", F.concat(F.lit("u"), F.col("k")).alias("f"), F.col("u").alias("z")))
    return rows.unionByName(states.select("trial", "t").distinct().select("trial", "t", F.lit("1").alias("f"), F.lit(1.0).alias("z")))


def _squares(features: DataFrame, covs: DataFrame) -> DataFrame:
    """(trial, t, f, g, zz): products of regressors at each step, with the covariance of states added."""
    other = features.select("trial", "t", F.col("f").alias("g"), F.col("z").alias("w"))
    own = covs.select("trial", "t", F.concat(F.lit("x"), F.col("k")).alias("f"), F.concat(F.lit("x"), F.col("l")).alias("g"), "v")
    rows = features.join(other, ["trial", "t"]).join(own, ["trial", "t", "f", "g"], "left")
    return rows.select("trial", "t", "f", "g", (F.col("z") * F.col("w") + F.coalesce("v", F.lit(0.0))).alias("zz"))


def group_moments(panel: DataFrame, groups: DataFrame, features: DataFrame, covs: DataFrame) -> DataFrame:
    """(grp, f, g, s, n): sums of products of regressors over the steps at which a group of variables (var, grp) is seen.

    Variables of a group are seen together, so one sum serves all of them.
    """
    seen = panel.where(F.col("y").isNotNull()).join(groups, "var").select("grp", "trial", "t").distinct()
    rows = _squares(features, covs).join(seen, ["trial", "t"])
    return rows.groupBy("grp", "f", "g").agg(F.sum("zz").alias("s"), F.count("*").alias("n"))


def observation_moments(panel: DataFrame, features: DataFrame) -> DataFrame:
    """(var, f, yz, yy, n): sums of observed y times each regressor, of y squared, and the observed cells."""
    rows = panel.where(F.col("y").isNotNull()).select("trial", "t", "var", F.col("y").cast("double").alias("y")).join(features, ["trial", "t"])
    return rows.groupBy("var", "f").agg(F.sum(F.col("y") * F.col("z")).alias("yz"), F.sum(F.col("y") ** 2).alias("yy"), F.count("*").alias("n"))


def dynamics_moments(features: DataFrame, covs: DataFrame, cross: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(f, g, s) and (k, f, s): products of regressors, and of the next step's states with them, over steps with a next one.

    cross: (trial, t, k, l, v), the covariance of state k at t with state l at t - 1.
    """
    states = features.where(F.col("f").startswith("x"))
    after = states.select("trial", (F.col("t") - 1).alias("t"), F.col("f").alias("k"), F.col("z").alias("x"))
    early = features.join(after.select("trial", "t").distinct(), ["trial", "t"], "left_semi")
    own = covs.join(after.select("trial", "t").distinct(), ["trial", "t"], "left_semi")
    past = _squares(early, own).groupBy("f", "g").agg(F.sum("zz").alias("s"))
    v = cross.select("trial", (F.col("t") - 1).alias("t"), F.concat(F.lit("x"), F.col("k")).alias("k"), F.concat(F.lit("x"), F.col("l")).alias("f"), "v")
    both = after.join(early, ["trial", "t"]).join(v, ["trial", "t", "k", "f"], "left")
    return past, both.groupBy("k", "f").agg(F.sum(F.col("x") * F.col("z") + F.coalesce("v", F.lit(0.0))).alias("s"))


TERMS = "var long, sums array<double>"
STATE = "var long, b array<double>, loss double, step array<double>, gain double, scale double, slope double, n double, done boolean"


def _terms(rows: DataFrame, p: int, spread: int) -> DataFrame:
    """(var, sums): count, loss, gradient and packed Hessian of the negative log-likelihood at ``try`` over rows (var, y, z, v, offset, try).

    Rates are averaged over the normal spread v of the first ``spread`` regressors.
    A task holds one packed line a variable and sends it once it has ``held`` of them; lines of one variable are added up by Spark.
    """
    upper = np.triu_indices(p)
    held_at_most = max(1, 1 << 22 >> (2 * p.bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["var", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            var, y, offset = (batch.column(c).to_numpy() for c in ("var", "y", "offset"))
            z, b = (batch.column(c).flatten().to_numpy().reshape(len(y), p) for c in ("z", "try"))
            drive = (z * b).sum(axis=1) + offset
            v, bent = (batch.column("v").flatten().to_numpy().reshape(len(y), spread, spread), b[:, :spread]) if spread else (np.zeros((len(y), 0, 0)), b[:, :0])
            lift = np.einsum("rij,rj->ri", v, bent)
            with np.errstate(over="ignore"):
                rate = np.exp(drive + 0.5 * (lift * bent).sum(axis=1))  # infinite for a step too far, which is refused
            for name in np.unique(var):
                own = var == name
                r, x, raised = rate[own], z[own], z[own].copy()
                raised[:, :spread] += lift[own]
                with np.errstate(invalid="ignore"):
                    grad, hess = x.T @ (r - y[own]), (raised * r[:, None]).T @ raised
                    grad[:spread] += lift[own].T @ r
                    hess[:spread, :spread] += np.einsum("r,rij->ij", r, v[own])
                    line = np.concatenate([[own.sum(), (r - y[own] * drive[own]).sum()], grad, hess[upper]])
                held[int(name)] = held[int(name)] + line if int(name) in held else line
            if len(held) >= held_at_most:
                yield sent()
                held.clear()
        if held:
            yield sent()

    made = rows.select("var", "y", "z", "v", "offset", "try").mapInArrow(run, TERMS)
    width = 2 + p + len(upper[0])
    return made.groupBy("var").agg(F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width)]).alias("sums"))


def poisson_regression(rows: DataFrame, p: int, *, penalty: float | np.ndarray = 0.1, rounds: int = 100, tolerance: float = 1e-16, start: DataFrame | None = None, spread: int = 0) -> DataFrame:
    """(var, b array, loss, slope, n) for rows (var, y, z array of p regressors, offset): y ~ Poisson(exp(b z + offset)), penalty b' P b / 2.

    With ``spread`` the first regressors are means of normal variables whose covariance is in the rows' column v, row by row; the
    loss is then the expected one, whose rate is exp(b z + offset + b' v b / 2).
    penalty: P, or the factor of a unit matrix. Newton's method for all variables at once: a round is one pass over the rows, in which each
    variable tries one point. Where the loss falls enough the step is taken and a new one is made, else it is halved. The start is
    the least squares fit of the logarithm of the mean rate, so large counts begin near their optimum, or the table (var, b) given. It ends when no variable's
    step promises more than ``tolerance`` of its loss. loss: the penalised negative log-likelihood without the factorials; slope: the largest entry
    of its gradient. Rows with null y, z or offset don't count; without penalty, a variable without any count has no optimum and
    stops far out. State is one row a variable and is stored between rounds; so are the rows, once.
    """
    P = np.asarray(penalty, float) * np.eye(p) if np.ndim(penalty) == 0 else np.asarray(penalty, float)
    kind = rows.schema["var"].dataType
    v = F.col("v") if spread else F.lit(None).cast("array<double>").alias("v")
    whole = rows.where("y IS NOT NULL AND z IS NOT NULL AND offset IS NOT NULL" + (" AND v IS NOT NULL" if spread else ""))
    rows = stored(whole.select(F.col("var").cast("long").alias("var"), F.col("y").cast("double").alias("y"), "z", v, F.col("offset").cast("double").alias("offset")))
    mean = rows.groupBy("var").agg(F.log(F.greatest(F.sum("y"), F.lit(0.5)) / F.sum(F.exp("offset"))).alias("level"), *[F.avg(F.get("z", F.lit(k))).alias(f"z{k}") for k in range(p)])
    norm = sum(F.col(f"z{k}") ** 2 for k in range(p))
    first = start.select(F.col("var").cast("long").alias("var"), "b") if start is not None else mean.select("var", F.array(*[F.when(norm > 0, F.col("level") * F.col(f"z{k}") / norm).otherwise(0.0) for k in range(p)]).alias("b"))
    none, upper = F.lit(None).cast("double"), np.triu_indices(p)
    state = stored(first.select("var", "b", none.alias("loss"), F.array_repeat(F.lit(0.0), p).alias("step"), none.alias("gain"), F.lit(1.0).alias("scale"), none.alias("slope"), none.alias("n"), F.lit(False).alias("done")))

    def update(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([moved(r) for r in frame.itertuples(index=False)], columns=[c.split()[0] for c in STATE.split(", ")])

    def moved(r) -> tuple:
        """A variable's next line: its step taken and a new one made, or its step halved."""
        b, step, sums = np.asarray(r.b, float), np.asarray(r.step, float), np.asarray(r.sums, float)
        at = b + r.scale * step
        loss, grad = sums[1] + at @ P @ at / 2, sums[2 : 2 + p] + P @ at
        known = r.loss is not None and r.loss == r.loss
        if known and not loss <= r.loss - 1e-4 * r.scale * r.gain + 1e-12 * abs(r.loss):
            return r.var, b, r.loss, step, r.gain, r.scale / 2, r.slope, r.n, r.scale < 1e-10
        hess = np.zeros((p, p))
        hess[upper] = sums[2 + p :]
        hess = hess + np.triu(hess, 1).T + P
        new = np.linalg.lstsq(hess + 1e-12 * np.trace(hess) / p * np.eye(p), -grad, rcond=None)[0]
        gain = float(-grad @ new)
        return r.var, at, loss, new, gain, 1.0, np.abs(grad).max(), sums[0], gain <= tolerance * max(abs(loss), 1.0)

    for _ in range(rounds):
        open_ = state.where("NOT done")
        tried = open_.select("var", F.zip_with("b", F.transform("step", lambda s: s * F.col("scale")), lambda a, s: a + s).alias("try"))
        sums = _terms(rows.join(tried, "var"), p, spread)
        moved_on = open_.join(sums, "var").mapInPandas(update, STATE)
        state = stored(moved_on.unionByName(state.where("done")))
        if state.where("NOT done").isEmpty():
            break
    return state.select(F.col("var").cast(kind).alias("var"), "b", "loss", "slope", F.col("n").cast("long").alias("n"))


def smoothness(p: int, weight: float, ridge: float = 0.0) -> np.ndarray:
    """The penalty matrix of squared differences between neighbouring coefficients, as a smooth rate over time asks for."""
    d = np.diff(np.eye(p), axis=0)
    return weight * d.T @ d + ridge * np.eye(p)


def observation_step(counts: DataFrame, states: DataFrame, n: int, *, past: int = 0, penalty: float | np.ndarray = 0.1) -> DataFrame:
    """(var, c array, d, w array, loss, slope, n): loadings, offset and weights of its own last ``past`` counts for every variable.

    counts: (trial, t, var, y), a row for every step of a trial's span, with null y where nothing was seen; states: (trial, t, x, v), as inference
    leaves them for ``n`` latent dimensions. The rate is exp(c x + d + w h), averaged over the spread of x. Steps that lack a seen count,
    one of the last ``past`` ones or a state don't count. Counts and states meet by (trial, t); then it is one regression for all variables.
    penalty: on c, d and w in this order, as in ``poisson_regression``.
    """
    before = [F.lag("y", k).over(Window.partitionBy("trial", "var").orderBy("t")).cast("double") for k in range(1, past + 1)]
    rows = counts.select("trial", "t", "var", "y", F.array(*before).cast("array<double>").alias("h"))
    rows = rows.where(F.col("y").isNotNull() & F.forall("h", lambda x: x.isNotNull())).join(states.select("trial", "t", "x", "v"), ["trial", "t"])
    z = F.concat("x", F.array(F.lit(1.0)), "h")
    found = poisson_regression(rows.select("var", "y", z.alias("z"), "v", F.lit(0.0).alias("offset")), n + 1 + past, penalty=penalty, spread=n)
    part = lambda a, size: F.slice("b", a + 1, size)
    return found.select("var", part(0, n).alias("c"), F.get("b", F.lit(n)).alias("d"), part(n + 1, past).alias("w"), "loss", "slope", "n")
