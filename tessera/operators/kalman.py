"""Linear dynamical systems per trial: filter, smoother, moments; one-dimensional ones over every series."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import shared_out

#: Mean and covariance of a state.
State = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Model:
    """x' = A x + B u' + noise(Q), y = C x + d + noise(diag R), x_0 ~ (mu0, V0); without B there are no inputs u."""

    A: np.ndarray
    Q: np.ndarray
    mu0: np.ndarray
    V0: np.ndarray
    C: np.ndarray
    d: np.ndarray
    R: np.ndarray
    B: np.ndarray | None = None

    def drift(self, u: np.ndarray | None) -> np.ndarray:
        """What the input of a step adds to its state."""
        return np.zeros(len(self.mu0)) if self.B is None or u is None else self.B @ u

    def move(self, u: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """A and Q of the move to a step with this input."""
        return self.A, self.Q


def filtered(model: Model, y: np.ndarray, u: np.ndarray | None = None, before: State | None = None) -> tuple[np.ndarray, ...]:
    """Means and covariances before and after each step and the log-likelihood; NaN cells aren't observed.

    before: the filtered state of the step before the first one; without it the first step is the trial's, which no input reaches.
    """
    n, steps = len(model.mu0), len(y)
    m, p = np.zeros((steps, n)), np.zeros((steps, n, n))
    mu, v, ll = np.zeros((steps, n)), np.zeros((steps, n, n)), np.zeros(steps)
    for t in range(steps):
        past = (mu[t - 1], v[t - 1]) if t else before
        A, Q = model.move(None if u is None else u[t])
        m[t] = model.mu0 if past is None else A @ past[0] + model.drift(None if u is None else u[t])
        p[t] = model.V0 if past is None else A @ past[1] @ A.T + Q
        on = np.isfinite(y[t])
        mu[t], v[t] = m[t], p[t]
        if on.any():
            c, r = model.C[on], model.R[on]
            e = y[t, on] - model.d[on] - c @ m[t]
            s = c.T @ (c / r[:, None])
            k = np.linalg.inv(s + np.linalg.inv(p[t]))
            w = c.T @ (e / r)
            mu[t] = m[t] + k @ w
            v[t] = (k + k.T) / 2
            _, det = np.linalg.slogdet(np.eye(n) + s @ p[t])
            ll[t] = -0.5 * ((e * e / r).sum() - w @ k @ w + np.log(r).sum() + det + on.sum() * np.log(2 * np.pi))
    return m, p, mu, v, ll


def smoothed(model: Model, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Smoothed means, covariances, covariances with the step before, and the log-likelihood."""
    return smoothed_segment(model, y)[:4]


def smoothed_segment(model: Model, y: np.ndarray, u: np.ndarray | None = None, before: State | None = None, after: State | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, State | None]:
    """``smoothed`` for consecutive steps of a trial, and the smoothed state of the step before them.

    before: the filtered state of that step (None at a trial's start); after: the smoothed state of the last step (None at its end).
    """
    m, p, mu, v, ll = filtered(model, y, u, before)
    xs, vs, cross = mu.copy(), v.copy(), np.zeros_like(v)
    if after is not None:
        xs[-1], vs[-1] = after
    first = None
    for t in range(len(y) - 2, -1 if before is None else -2, -1):
        past = (mu[t], v[t]) if t >= 0 else before
        j = past[1] @ model.move(None if u is None else u[t + 1])[0].T @ np.linalg.inv(p[t + 1])
        x, c = past[0] + j @ (xs[t + 1] - m[t + 1]), past[1] + j @ (vs[t + 1] - p[t + 1]) @ j.T
        cross[t + 1] = vs[t + 1] @ j.T
        if t >= 0:
            xs[t], vs[t] = x, c
        else:
            first = (x, c)
    return xs, vs, cross, float(ll.sum()), first


def matrix(frame: pd.DataFrame, n_vars: int) -> np.ndarray:
    """[steps, n_vars] of a trial's rows (t, y array), in time order; null is NaN."""
    rows = frame.sort_values("t")["y"]
    out = np.array([[np.nan if x is None else x for x in row] for row in rows], float)
    return out.reshape(len(rows), n_vars)


def posterior(packed: DataFrame, model: Model) -> DataFrame:
    """(trial, t, x, v, vv, loglik) per step of a packed panel (trial, t, y array); loglik is the trial's, at its first step only.

    The panel must hold every step of a trial's span: packed(every_step=True).
    """
    n_vars = len(model.d)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        xs, vs, cross, ll = smoothed(model, matrix(frame, n_vars))
        t = np.sort(frame["t"].to_numpy())
        return pd.DataFrame({"trial": frame["trial"].iloc[0], "t": t, "x": list(xs), "v": [a.ravel() for a in vs], "vv": [a.ravel() for a in cross], "loglik": np.r_[ll, np.zeros(len(t) - 1)]})

    return shared_out(packed, "trial").groupBy("trial").applyInPandas(run, "trial int, t int, x array<double>, v array<double>, vv array<double>, loglik double")


def _series(panel: DataFrame, schema: str, run: Callable[[list[int], list[float | None]], Iterator[tuple]]) -> DataFrame:
    """(trial, var, *schema): what ``run`` makes of the sorted steps and values of each series (trial, var).

    Series are dealt out by hash and stream through their tasks sorted, one at a time.
    """
    names = ["trial", "var", *[c.split()[0] for c in schema.split(", ")]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, steps, values, out = None, [], [], []
        made = lambda: pa.record_batch([pa.array(c, pa.int32() if k < 3 else pa.float64()) for k, c in enumerate(zip(*out, strict=True))], names)
        for batch in batches:
            for trial, var, t, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (trial, var) != key:
                    if steps:
                        out += [(*key, *x) for x in run(steps, values)]
                    key, steps, values = (trial, var), [], []
                    if len(out) > 50_000:
                        yield made()
                        out = []
                steps.append(t)
                values.append(y)
        if steps:
            out += [(*key, *x) for x in run(steps, values)]
        if out:
            yield made()

    rows = panel.select(*[F.col(c).cast("int").alias(c) for c in ("trial", "var", "t")], F.col("y").cast("double").alias("y"))
    rows = rows.repartition("trial", "var").sortWithinPartitions("trial", "var", "t")
    return rows.mapInArrow(fold, f"trial int, var int, {schema}")


@dataclass(frozen=True)
class Scalar:
    """x' = a x + noise(q), y = c x + d + noise(r), x_0 ~ (mu0, v0)."""

    a: float
    q: float
    c: float
    d: float
    r: float
    mu0: float
    v0: float

    def passed(self, steps: list[int], values: list[float | None]) -> Iterator[tuple[int, float, float, float, float]]:
        """(t, predicted mean and variance, mean, variance) of every step from the first to the last; steps that are missing or null are predicted through."""
        mu, v, seen = 0.0, 0.0, dict(zip(steps, values, strict=True))
        for t in range(steps[0], steps[-1] + 1):
            m, p = (self.mu0, self.v0) if t == steps[0] else (self.a * mu, self.a * self.a * v + self.q)
            y = seen.get(t)
            mu, v = m, p
            if y is not None and y == y:
                v = 1 / (self.c * self.c / self.r + 1 / p)
                mu = m + v * self.c * (y - self.d - self.c * m) / self.r
            yield t, m, p, mu, v


def scalar_filter(panel: DataFrame, *, every_step: bool = False, **model: float) -> DataFrame:
    """(trial, var, t, mu, v): a one-dimensional filter over each series; a null or missing step is predicted through.

    Missing steps have rows of their own only with every_step.
    """
    one = Scalar(**model)

    def run(steps: list[int], values: list[float | None]) -> Iterator[tuple[int, float, float]]:
        given = set(steps)
        return ((t, mu, v) for t, _, _, mu, v in one.passed(steps, values) if every_step or t in given)

    return _series(panel, "t int, mu double, v double", run)


def scalar_smoother(panel: DataFrame, **model: float) -> DataFrame:
    """(trial, var, t, x, v) for every step between a series' first and last: a one-dimensional smoother."""
    one = Scalar(**model)

    def run(steps: list[int], values: list[float | None]) -> list[tuple[int, float, float]]:
        done = list(one.passed(steps, values))
        out = [(done[-1][0], done[-1][3], done[-1][4])]
        for (t, _, _, mu, v), (_, m1, p1, _, _) in zip(done[-2::-1], done[:0:-1], strict=True):
            j = v * one.a / p1
            out.append((t, mu + j * (out[-1][1] - m1), v + j * j * (out[-1][2] - p1)))
        return out[::-1]

    return _series(panel, "t int, x double, v double", run)


def transformed(states: DataFrame, by: np.ndarray, *more: str) -> DataFrame:
    """states (x array, v flat array, other columns) in other coordinates: M x and M V M', also for further covariances ``more``."""
    n = len(by)
    m = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in by])
    dot = lambda row, col: F.aggregate(F.zip_with(row, col, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    x = F.transform(m, lambda row: dot(row, F.col("x")))
    left = lambda c: F.flatten(F.transform(m, lambda row: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: dot(row, F.filter(c, lambda _, k: k % n == j - 1)))))
    both = lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(m, lambda row: dot(row, F.slice(c, i * n + 1, n)))))
    for c in ("v", *more):
        states = states.withColumn("left", left(c)).withColumn(c, both("left"))
    return states.drop("left").withColumn("x", x)


def suffstats(panel: DataFrame, states: DataFrame) -> DataFrame:
    """(var, n, sy, syy, sx, sxx, syx) of observed cells y and scalar states (trial, var, t, mu, v)."""
    rows = panel.where(F.col("y").isNotNull()).join(states, ["trial", "var", "t"])
    y, x = F.col("y").cast("double"), F.col("mu")
    return rows.groupBy("var").agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(x).alias("sx"), F.sum(x * x + F.col("v")).alias("sxx"), F.sum(y * x).alias("syx"))
