"""Learning jobs: expectation maximisation over trials and subspace identification from lag covariances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import scan, tasksums
from tessera.operators.kalman import Model
from tessera.sources.store import shared_dir

def start_model(n: int, means: np.ndarray, variances: np.ndarray, seed: int = 0) -> Model:
    """Stable dynamics, random loadings scaled to the data, half of each variance as noise."""
    rng = np.random.default_rng(seed)
    load = rng.standard_normal((len(means), n)) * np.sqrt(np.maximum(variances, 1e-6) / 2 / n)[:, None]
    return Model(0.8 * np.eye(n), 0.36 * np.eye(n), np.zeros(n), np.eye(n), load, means, np.maximum(variances, 1e-6) / 2)


def segment_statistics(model: Model, y: np.ndarray, u: np.ndarray | None, groups: np.ndarray, found: tuple) -> tasksums.Arrays:
    """Sums of posterior moments over a segment's steps and over the transitions into them.

    groups: the number of each variable's group, whose variables are seen together. States are summed once a group, over the steps
    at which it is seen; found: what ``kalman.smoothed_segment`` gives.
    """
    xs, vs, cross, ll, past = found
    e = vs + xs[:, :, None] * xs[:, None, :]
    on = np.isfinite(y)
    full, n, steps = np.where(on, y, 0), xs.shape[1], len(y)
    seen = np.zeros((steps, int(groups.max(initial=-1)) + 1))
    seen[:, groups] = on
    if (seen[:, groups] != on).any():
        raise ValueError("variables of one group are not seen together")
    one = lambda a: np.atleast_2d(np.asarray(a, float))
    sums = {"ll": one(ll), "y": one(full.sum(0)), "yy": one((full**2).sum(0)), "yx": full.T @ xs, "n": one(seen.sum(0)), "x": seen.T @ xs, "xx": seen.T @ e.reshape(steps, n * n)}
    before_x, before_e = (xs[:-1], e[:-1]) if past is None else (np.vstack([past[0][None], xs[:-1]]), np.concatenate([(past[1] + np.outer(past[0], past[0]))[None], e[:-1]]))
    own = steps - len(before_x)  # the trial's first step has none before it
    sums |= {"steps": one(len(before_x)), "past": before_e.sum(0), "next": e[own:].sum(0), "lag": (cross[own:] + xs[own:, :, None] * before_x[:, None, :]).sum(0)}
    if u is not None:
        sums |= {"uu": u[own:].T @ u[own:], "nu": xs[own:].T @ u[own:], "pu": before_x.T @ u[own:]}
    if past is None:
        sums |= {"trials": one(1.0), "x0": one(xs[0]), "x0x0": e[0]}
    return sums


def e_step(rows: DataFrame, model: Model, groups: np.ndarray | None = None) -> tasksums.Arrays:
    """The summed statistics of all segments of ``scan.chunks``; nothing without rows.

    A task adds up its segments in one set of arrays, an n x n sum a group of variables, and sends one row.
    """
    kinds = np.arange(len(model.d)) if groups is None else np.asarray(groups)

    def part(batch: pa.RecordBatch) -> Iterator[tasksums.Arrays]:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield segment_statistics(model, *scan.cells(row, model), kinds, scan.finished(row, model))

    return tasksums.summed(scan.framed(rows, model), part)


def dynamics(s: tasksums.Arrays, old: Model | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """A, Q, mu0, V0 and B from summed moments: one regression of the next state on the state and the input before it.

    Where no trial has a second step A, Q and B stay those of the old model.
    """
    n, trials, steps = s["past"].shape[0], s["trials"][0, 0], s["steps"][0, 0]
    mu0 = s["x0"][0] / trials
    v0 = s["x0x0"] / trials - np.outer(mu0, mu0)
    even = lambda m: (m + m.T) / 2
    v0 = even(v0) + 1e-9 * np.eye(n)
    if not steps:
        return old.A, old.Q, mu0, v0, old.B
    inner, outer = s["past"], s["lag"]
    if "uu" in s:
        inner, outer = np.block([[s["past"], s["pu"]], [s["pu"].T, s["uu"]]]), np.hstack([s["lag"], s["nu"]])
    ab = np.linalg.lstsq(inner.T, outer.T, rcond=None)[0].T
    q = (s["next"] - ab @ outer.T - outer @ ab.T + ab @ inner @ ab.T) / steps
    return ab[:, :n], even(q) + 1e-12 * np.eye(n), mu0, v0, ab[:, n:] if "uu" in s else None


def m_step(s: tasksums.Arrays, old: Model | None = None, groups: np.ndarray | None = None) -> Model:
    """Closed-form parameters; loadings, offsets and noise come from the steps at which a variable's group is seen.

    A variable that is never seen has loading and offset 0 and noise 1.
    """
    a, q, mu0, v0, b = dynamics(s, old)
    n, p = len(mu0), len(s["yx"])
    groups = np.arange(p) if groups is None else np.asarray(groups)
    c, d, r = np.zeros((p, n)), np.zeros(p), np.ones(p)
    for g in range(len(s["xx"])):
        count, xx, x, own = s["n"][0, g], s["xx"][g].reshape(n, n), s["x"][g], groups == g
        if count:
            y, yy, yx = s["y"][0, own], s["yy"][0, own], s["yx"][own]
            c[own] = np.linalg.lstsq(xx - np.outer(x, x) / count, (yx - np.outer(y, x) / count).T, rcond=None)[0].T
            d[own] = (y - c[own] @ x) / count
            r[own] = (yy - 2 * d[own] * y - 2 * (c[own] * yx).sum(1) + ((c[own] @ xx) * c[own]).sum(1) + 2 * d[own] * (c[own] @ x)) / count + d[own] ** 2
    return Model(a, q, mu0, v0, c, d, np.maximum(r, 1e-6), b)


PARAMETERS = "round int, name string, i int, j int, value double"


def saved(model: Model, number: int, loglik: float) -> list[tuple]:
    """The rows of PARAMETERS of one round; loglik is that of the model before it."""
    cells = {**{k: np.atleast_2d(v) for k, v in vars(model).items() if v is not None}, "loglik": np.array([[loglik]])}
    return [(number, k, i, j, float(x)) for k, a in cells.items() for (i, j), x in np.ndenumerate(a)]


def restored(table: DataFrame) -> tuple[int, Model, list[float]] | None:
    """The last round of a table of PARAMETERS, its model, and the log-likelihoods so far; None for an empty table.

    Its size is that of the parameters times the rounds.
    """
    rows = table.collect()
    if not rows:
        return None
    last = max(r["round"] for r in rows)
    trace = [r["value"] for r in sorted(rows, key=lambda r: r["round"]) if r["name"] == "loglik"]
    cells = {}
    for name in vars_of(Model):
        own = [r for r in rows if r["round"] == last and r["name"] == name]
        if not own:  # B of a model without inputs
            continue
        cells[name] = np.zeros((max(r["i"] for r in own) + 1, max(r["j"] for r in own) + 1))
        for r in own:
            cells[name][r["i"], r["j"]] = r["value"]
    return last, Model(**{k: v[0] if k in ("mu0", "d", "R") else v for k, v in cells.items()}), trace


def vars_of(kind: type) -> list[str]:
    return [f.name for f in fields(kind)]


def fit(packed: DataFrame, start: Model, rounds: int = 10, gain: float = 1e-6, folder: str | None = None, *, inputs: DataFrame | None = None, groups: np.ndarray | None = None, segment: int = 1000) -> tuple[Model, list[float]]:
    """Rounds of e_step and m_step until the log-likelihood gains less than ``gain``; returns the model and the trace.

    Every round's parameters are appended to a table in ``folder``; a fit that finds one there goes on from its last round.
    packed holds every step of a trial's span; it is stored once, by segments of ``segment`` steps, which share out a long trial's work.
    inputs: (trial, t, u array), for a start model with B. groups: each variable's group, of variables that are always seen together;
    states are then summed once a group, with the same result. A panel without rows gives the start model and no trace;
    one whose trials have a single step keeps A, Q and B.
    """
    spark = packed.sparkSession
    folder = folder or shared_dir(spark) + "/rounds"
    rows = scan.chunks(packed, segment, inputs)
    number, model, trace = resumed(spark, folder) or (0, start, [])
    while number < rounds and not (len(trace) > 1 and trace[-1] - trace[-2] <= gain):
        s = e_step(rows, model, groups)
        if not s:
            break
        trace.append(float(s["ll"][0, 0]))
        model, number = m_step(s, model, groups), number + 1
        append_round(spark, folder, model, number, trace[-1])
    return model, trace


def append_round(spark: SparkSession, folder: str, model: Model, number: int, loglik: float) -> None:
    spark.createDataFrame(saved(model, number, loglik), PARAMETERS).coalesce(1).write.mode("append").parquet(folder)


def resumed(spark: SparkSession, folder: str) -> tuple[int, Model, list[float]] | None:
    """``restored`` from a folder; None where there is no table yet."""
    return restored(spark.read.schema(PARAMETERS).parquet(folder)) if _exists(spark, folder) else None


def at_round(spark: SparkSession, folder: str, number: int, start: Model) -> Model:
    """The model that a folder's table has for a round; round 0 is the start."""
    return restored(spark.read.schema(PARAMETERS).parquet(folder).where(F.col("round") <= number))[1] if number else start


def _exists(spark: SparkSession, folder: str) -> bool:
    """Whether Spark can read a table there."""
    try:
        spark.read.parquet(folder)
    except AnalysisException:
        return False
    return True


def saved_rounds(packed: DataFrame, start: Model, rounds: int, **options) -> DataFrame:
    """The table of PARAMETERS that a fit leaves; options are those of ``fit``."""
    folder = shared_dir(packed.sparkSession) + "/rounds"
    fit(packed, start, rounds, folder=folder, **options)
    spark = packed.sparkSession
    return spark.read.schema(PARAMETERS).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], PARAMETERS)


def online(packed: DataFrame, start: Model, *, batches: int = 4, blend: float = 0.6, segment: int = 1000, deal: Column | None = None) -> tuple[Model, list[tuple[int, float]]]:
    """Expectation maximisation by batches of trials: sums are blended with those of batches before.

    deal: the number of each row's batch; left out, trials are dealt by a hash. Batch k counts with weight (k + 1) ** -blend, and the
    older sums with what is left; returns the model and, by batch, its trials and their mean log-likelihood. Sums are per
    trial, so batches of different sizes mix.
    """
    deal = F.pmod(F.xxhash64("trial"), F.lit(batches)) if deal is None else deal
    rows = scan.chunks(packed, segment)
    model, held, trace = start, None, []
    for k in range(batches):
        s = e_step(rows.where(deal == k), model)
        if not s:
            continue
        trials = s["trials"][0, 0]
        trace.append((int(trials), float(s["ll"][0, 0] / trials)))
        weight = 1.0 if held is None else (k + 1) ** -blend
        held = {name: weight * a / trials + (1 - weight) * (0 if held is None else held[name]) for name, a in s.items()}
        model = m_step(held, model)
    return model, trace


def lyapunov(a: np.ndarray, q: np.ndarray, rounds: int = 60) -> np.ndarray:
    """X with X = A X A' + Q, by doubling."""
    x = q.copy()
    for _ in range(rounds):
        x, a = x + a @ x @ a.T, a @ a
    return (x + x.T) / 2


def in_basis(model: Model, m: np.ndarray) -> Model:
    """The model of the states m x."""
    back = np.linalg.inv(m)
    return Model(m @ model.A @ back, m @ model.Q @ m.T, m @ model.mu0, m @ model.V0 @ m.T, model.C @ back, model.d, model.R, None if model.B is None else m @ model.B)


def canonical(model: Model, kind: str = "orthonormal") -> tuple[np.ndarray, Model]:
    """The change of basis to a canonical form, and the model in it; ``kalman.transformed`` takes posterior tables there.

    orthonormal: C'C = I and a diagonal stationary covariance of the states, in falling order. unit_states: a stationary covariance of I and
    orthogonal loadings, in falling order. unit_loadings: states scaled so that each column of C has length 1. Where A has no stationary
    covariance, Q stands for it. Components' signs make the largest loading of each positive.
    """
    spread = lambda a, q: q if np.abs(np.linalg.eigvals(a)).max() >= 1 else lyapunov(a, q)
    falling = lambda x: np.linalg.eigh(x)[1][:, ::-1].T
    if kind == "orthonormal":
        _, size, right = np.linalg.svd(model.C, full_matrices=False)
        m = size[:, None] * right
        now = in_basis(model, m)
        m = falling(spread(now.A, now.Q)) @ m
    elif kind == "unit_states":
        w, e = np.linalg.eigh(spread(model.A, model.Q))
        m = (e / np.sqrt(np.maximum(w, 1e-12))).T
        now = in_basis(model, m)
        m = falling(now.C.T @ now.C) @ m
    elif kind == "unit_loadings":
        m = np.diag(np.sqrt((model.C**2).sum(axis=0)))
    else:
        raise ValueError(f"kind: {kind}")
    c = model.C @ np.linalg.inv(m)
    m = np.where(c[np.abs(c).argmax(axis=0), np.arange(len(m))] < 0, -1.0, 1.0)[:, None] * m
    return m, in_basis(model, m)


def subspace(lag_cov: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A, C, state covariance and R from lag covariances [2k, p, p] by the singular vectors of their Hankel matrix."""
    p = lag_cov.shape[1]
    h = np.block([[lag_cov[r + c + 1] for c in range(k)] for r in range(k)])
    u, s, vt = np.linalg.svd(h)
    o, reach = u[:, :n] * np.sqrt(s[:n]), np.sqrt(s[:n])[:, None] * vt[:n]
    a = np.linalg.pinv(o[:-p]) @ o[p:]
    c, g = o[:p], reach[:, :p]
    top = np.abs(np.linalg.eigvals(a)).max(initial=0.0)
    a = a * min(1.0, 0.99 / max(top, 1e-12)) if top >= 1 else a
    pi = np.linalg.pinv(a) @ g @ np.linalg.pinv(c.T)
    w, e = np.linalg.eigh((pi + pi.T) / 2)
    pi = (e * np.maximum(w, 1e-5)) @ e.T
    return a, c, pi, np.maximum(np.diag(lag_cov[0] - c @ pi @ c.T), 1e-5)


def dense(lagcov: DataFrame, lags: int, n_vars: int) -> np.ndarray:
    """[lags, n_vars, n_vars] of a lag covariance table (its size is known beforehand)."""
    out = np.zeros((lags, n_vars, n_vars))
    for r in lagcov.collect():
        out[r["m"], r["i"], r["j"]] = r["q"]
    return out
