"""Poisson observations: Laplace inference per trial, learning of the loadings, prediction and sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.links import LINKS
from tessera.jobs import fitting
from tessera.operators import lagcov, scan, tasksums
from tessera.operators.kalman import Model, matrix
from tessera.sources.store import shared_dir, shared_out

#: More steps than a trial has: inference of counts works on whole trials.
WHOLE = 1 << 40


def _factored(diag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and multipliers of one forward elimination of a symmetric block-tridiagonal matrix.

    diag: [T, n, n], off: [T-1, n, n] blocks (t, t+1).
    """
    s, g = np.empty_like(diag), np.empty_like(off)
    s[0] = diag[0]
    for t in range(len(off)):
        g[t] = np.linalg.solve(s[t], off[t]).T
        s[t + 1] = diag[t + 1] - g[t] @ off[t]
    return s, g


def _solved(inverses: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with H x = b [T, n], from H's inverted pivots and its multipliers."""
    y = b.copy()
    for t in range(len(g)):
        y[t + 1] -= g[t] @ y[t]
    x = np.einsum("tij,tj->ti", inverses, y)
    for t in range(len(g) - 1, -1, -1):
        x[t] -= x[t + 1] @ g[t]
    return x


def _inverse(inverses: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The diagonal and upper blocks of the inverse of the matrix with these inverted pivots and multipliers."""
    inv, up = inverses.copy(), np.empty_like(g)
    for t in range(len(g) - 1, -1, -1):
        up[t] = -g[t].T @ inv[t + 1]
        inv[t] -= up[t] @ g[t]
    return inv, up


def _solve_blocks(diag: np.ndarray, off: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x with H x = b for a symmetric block-tridiagonal H, and the diagonal and upper blocks of its inverse.

    diag: [T, n, n], off: [T-1, n, n] blocks (t, t+1), b: [T, n]. One forward elimination, one pass back.
    """
    s, g = _factored(diag, off)
    inverses = np.linalg.inv(s)
    return _solved(inverses, g, b), *_inverse(inverses, g)


def prior_blocks(model: Model, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper blocks of the prior precision, and the prior mean path."""
    n = len(model.mu0)
    qi = np.linalg.inv(model.Q)
    diag = np.tile(qi, (steps, 1, 1))
    diag[0] = np.linalg.inv(model.V0)
    diag[:-1] += model.A.T @ qi @ model.A
    off = np.tile(-model.A.T @ qi, (max(steps - 1, 0), 1, 1)).reshape(max(steps - 1, 0), n, n)
    mean = np.empty((steps, n))
    mean[0] = model.mu0
    for t in range(1, steps):
        mean[t] = model.A @ mean[t - 1]
    return diag, off, mean


def _times(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.einsum("tij,tj->ti", diag, x)
    if len(off):
        out[:-1] += np.einsum("tij,tj->ti", off, x[1:])
        out[1:] += np.einsum("tij,ti->tj", off, x[:-1])
    return out


def laplace(model: Model, y: np.ndarray, rounds: int = 100, tolerance: float = 1e-10, link: str = "exp") -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mode, covariances, covariances with the step before and the approximate evidence of one trial's counts (NaN unseen).

    The rate of a count is ``link`` (a name in links.LINKS) of C x + d. Newton on the log posterior; a step is halved until the
    posterior rises.
    """
    diag, off, mean = prior_blocks(model, len(y))
    on = np.isfinite(y)
    counts = np.where(on, y, 0.0)

    terms = LINKS[link].terms

    def value(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        fit, pull, bend = (np.where(on, a, 0.0) for a in terms(counts, x @ model.C.T + model.d))
        z = x - mean
        return float(fit.sum() - 0.5 * (z * _times(diag, off, z)).sum()), pull, bend, z

    x = mean.copy()
    now, pull, bend, z = value(x)
    for _ in range(rounds):
        grad = pull @ model.C - _times(diag, off, z)
        hess = diag + np.einsum("tp,pi,pj->tij", bend, model.C, model.C)
        step, _, _ = _solve_blocks(hess, off, grad)
        scale = 1.0
        while scale > 1e-8 and (new := value(x + scale * step))[0] < now:
            scale /= 2
        gain = new[0] - now
        if gain <= tolerance:
            break
        x = x + scale * step
        now, pull, bend, z = new
    hess = diag + np.einsum("tp,pi,pj->tij", bend, model.C, model.C)
    _, cov, up = _solve_blocks(hess, off, np.zeros_like(x))
    cross = np.zeros_like(cov)
    cross[1:] = np.transpose(up, (0, 2, 1))
    det = lambda d, o: np.linalg.slogdet(np.array(_pivots(d, o)))[1].sum()
    log_fact = np.array([np.log(np.arange(1, int(c) + 1)).sum() for c in counts.ravel()]).sum()
    return x, cov, cross, now - log_fact + 0.5 * (det(diag, off) - det(hess, off))


def _pivots(diag: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    return list(_factored(diag, off)[0])


def posterior(packed: DataFrame, model: Model, link: str = "exp") -> DataFrame:
    """(trial, t, x, v, bound) per step of a packed panel; bound is the trial's evidence, at its first step."""
    p = len(model.d)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, v, _, bound = laplace(model, matrix(frame, p), link=link)
        return pd.DataFrame({"trial": frame["trial"].iloc[0], "t": np.sort(frame["t"].to_numpy()), "x": list(x), "v": [a.ravel() for a in v], "bound": np.r_[bound, np.zeros(len(x) - 1)]})

    return shared_out(packed, "trial").groupBy("trial").applyInPandas(run, "trial int, t int, x array<double>, v array<double>, bound double")


def _loading_terms(model: Model, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient and Hessian, by variable, of the expected log-likelihood sum(y h - exp(h + C V C' / 2)), h = C x + d."""
    on = np.isfinite(y)
    one = np.ones((len(y), 1))
    xx = np.hstack([x, one])
    n = x.shape[1]
    cv = np.einsum("pi,tij->tpj", model.C, v)
    rate = np.where(on, np.exp(np.minimum(x @ model.C.T + model.d + 0.5 * np.einsum("tpj,pj->tp", cv, model.C), 50.0)), 0.0)
    lift = np.concatenate([xx[:, None, :n] + cv, np.ones((len(y), len(model.d), 1))], axis=2)
    grad = np.where(on, y, 0.0).T @ xx - np.einsum("tp,tpi->pi", rate, lift)
    hess = np.einsum("tp,tpi,tpj->pij", rate, lift, lift)
    hess[:, :n, :n] += np.einsum("tp,tij->pij", rate, v)
    return {"grad": grad, "hess": hess.reshape(len(model.d), -1)}


def e_step(rows: DataFrame, model: Model) -> tasksums.Arrays:
    """Summed moments of the dynamics and the loadings' Newton terms over all trials, one row of ``scan.chunks`` each."""

    def run(y: np.ndarray) -> tasksums.Arrays:
        x, v, cross, bound = laplace(model, y)
        e = v + x[:, :, None] * x[:, None, :]
        lag = cross[1:] + x[1:, :, None] * x[:-1, None, :]
        one = lambda a: np.atleast_2d(np.asarray(a, float))
        return {"ll": one(bound), "trials": one(1.0), "steps": one(len(y) - 1.0), "x0": one(x[0]), "x0x0": e[0], "past": e[:-1].sum(0), "next": e[1:].sum(0), "lag": lag.sum(0), **_loading_terms(model, y, x, v)}

    def part(batch: pa.RecordBatch) -> Iterator[tasksums.Arrays]:
        for k in range(batch.num_rows):
            yield run(scan.cells(batch.slice(k, 1).to_pylist()[0], model)[0])

    return tasksums.summed(rows, part)


def fit(packed: DataFrame, start: Model, rounds: int = 5, gain: float = 1e-6, folder: str | None = None) -> tuple[Model, list[float]]:
    """Laplace EM: closed-form dynamics, one damped Newton step of every variable's loading and offset a round.

    It ends after ``rounds`` or as soon as the evidence gains no more than ``gain``; the model with the largest evidence is returned,
    so a last round that made it fall doesn't count. Every round's parameters are appended to a table in ``folder``, from which a
    later fit goes on. packed holds every step of a trial's span. A panel without rows gives the start model and no trace.
    """
    spark = packed.sparkSession
    folder = folder or shared_dir(spark) + "/rounds"
    rows = scan.chunks(packed, WHOLE)
    number, model, trace = fitting.resumed(spark, folder) or (0, start, [])
    best = start if not trace else fitting.at_round(spark, folder, int(np.argmax(trace)), start)
    while number < rounds and not (len(trace) > 1 and trace[-1] - trace[-2] <= gain):
        s = e_step(rows, model)
        if not s:
            break
        trace.append(float(s["ll"][0, 0]))
        if trace[-1] >= max(trace):
            best = model
        a, q, mu0, v0, _ = fitting.dynamics(s, model)
        n = len(mu0)
        step = np.linalg.solve(s["hess"].reshape(len(model.d), n + 1, n + 1) + 1e-3 * np.eye(n + 1), s["grad"][:, :, None])[:, :, 0]
        step *= np.minimum(1.0, 1.0 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-12))
        model, number = Model(a, q, mu0, v0, model.C + step[:, :n], model.d + step[:, n], model.R), number + 1
        fitting.append_round(spark, folder, model, number, trace[-1])
    fell = len(trace) > 1 and trace[-1] < trace[-2]
    return best if fell else model, trace


def predict(packed: DataFrame, model: Model, condition: tuple[int, int], target: tuple[int, int], *, inputs: DataFrame | None = None, offsets: DataFrame | None = None, private: bool = False) -> DataFrame:
    """(trial, t, var, rate): expected counts at target steps given the counts of the condition steps (ends exclusive).

    Steps are those of the column t; unseen ones among the condition steps are predicted through. The state starts at
    the trial's first step in the condition range; a trial without any has no rows. inputs: (trial, t, u array), which drive the state
    through B at every step but the trial's first; offsets: (trial, t, s array), which are added to the drive of each variable. Both
    must reach over the target steps; missing ones count as zeros. With ``private`` the drive also has independent normal noise of
    variance R, which raises the expected count and is part of the observations.
    """
    p, n_inputs = len(model.d), 0 if model.B is None else model.B.shape[1]
    none = F.lit(None).cast("array<double>")
    rows = packed.where(F.col("t").between(condition[0], condition[1] - 1)).select("trial", "t", "y")
    ahead = rows.groupBy("trial").agg(F.min("t").alias("a"), F.lit(target[1] - 1).alias("b"))
    rows = lagcov.every(ahead).join(rows, ["trial", "t"], "left")
    rows = rows.join(inputs.select("trial", "t", "u"), ["trial", "t"], "left") if inputs is not None and n_inputs else rows.withColumn("u", none)
    rows = rows.join(offsets.select("trial", "t", "s"), ["trial", "t"], "left") if offsets is not None else rows.withColumn("s", none)

    def filled(cells: pd.Series, width: int, empty: float) -> np.ndarray:
        return np.array([[empty] * width if c is None else [np.nan if x is None else x for x in c] for c in cells], float).reshape(len(cells), width)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        y, u, s = filled(frame["y"], p, np.nan), filled(frame["u"], n_inputs, 0.0), filled(frame["s"], p, 0.0)
        t = frame["t"].to_numpy()
        seen = int(np.flatnonzero(np.isfinite(y).any(axis=1))[-1]) + 1 if np.isfinite(y).any() else 1
        x, v = at_end(model, y[:seen], u[:seen], s[:seen], private)
        out = []
        for k in range(seen, len(t)):
            x, v = model.A @ x + (model.B @ u[k] if n_inputs else 0.0), model.A @ v @ model.A.T + model.Q
            if t[k] >= target[0]:
                spread = np.einsum("pi,ij,pj->p", model.C, v, model.C) + (model.R if private else 0.0)
                rate = np.exp(model.C @ x + model.d + s[k] + 0.5 * spread)
                out += [(int(frame["trial"].iloc[0]), int(t[k]), i, float(r)) for i, r in enumerate(rate)]
        return pd.DataFrame(out, columns=["trial", "t", "var", "rate"])

    return shared_out(rows, "trial").groupBy("trial").applyInPandas(run, "trial int, t int, var int, rate double")


def at_end(model: Model, y: np.ndarray, u: np.ndarray, s: np.ndarray, private: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the last step's state given counts y, inputs u and offsets s of a trial's steps.

    Inputs shift the prior's mean path and offsets the drive. Private noise of a drive is a latent value of its own at each seen cell: it is
    integrated out by the cell's mode, so that the counts bear on the state through the sum of both.
    """
    n, p = len(model.mu0), len(model.d)
    diag, off, mean = prior_blocks(model, len(y))
    if u.shape[1]:
        drift = u @ model.B.T
        shift = np.zeros_like(mean)
        for t in range(1, len(y)):
            shift[t] = model.A @ shift[t - 1] + drift[t]
        mean = mean + shift
    on = np.isfinite(y)
    counts = np.where(on, y, 0.0)
    noise = model.R if private else np.zeros(p)

    def cells(drive: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The modes e of the private values, and the pull and bend of the drive with these integrated out."""
        for _ in range(60 if private else 0):
            rate = np.exp(np.minimum(drive + e, 50.0))
            step = (noise * (counts - rate) - e) / (1 + noise * rate)
            e = e + np.clip(step, -2.0, 2.0)
        rate = np.where(on, np.exp(np.minimum(drive + e, 50.0)), 0.0)
        return e, np.where(on, counts - rate, 0.0), rate / (1 + noise * rate)

    def height(x: np.ndarray, e: np.ndarray) -> float:
        drive, z = x @ model.C.T + model.d + s, x - mean
        own = np.where(on, counts * (drive + e) - np.exp(np.minimum(drive + e, 50.0)), 0.0).sum() - (0.5 * np.where(on, e * e, 0.0) / np.where(noise > 0, noise, 1.0)).sum()
        return float(own - 0.5 * (z * _times(diag, off, z)).sum())

    x, e = mean.copy(), np.zeros_like(counts)
    e, pull, bend = cells(x @ model.C.T + model.d + s, e)
    now = height(x, e)
    for _ in range(100):
        grad = pull @ model.C - _times(diag, off, x - mean)
        step, _, _ = _solve_blocks(diag + np.einsum("tp,pi,pj->tij", bend, model.C, model.C), off, grad)
        scale = 1.0
        while True:
            at = x + scale * step
            e_at, pull_at, bend_at = cells(at @ model.C.T + model.d + s, e)
            new = height(at, e_at)
            if new >= now or scale < 1e-8:
                break
            scale /= 2
        if new - now <= 1e-10:
            break
        x, e, pull, bend, now = at, e_at, pull_at, bend_at, new
    _, cov, _ = _solve_blocks(diag + np.einsum("tp,pi,pj->tij", bend, model.C, model.C), off, np.zeros_like(x))
    return x[-1].reshape(n), cov[-1]


def sample(trials: DataFrame, model: Model, steps: int, *, poisson: bool = True, most: float = 1e4, seed: int = 0) -> DataFrame:
    """(trial, t, var, y): one draw of the model for each row of trials (trial); a trial's draw depends on its number and the seed alone."""

    def run(frames):
        for frame in frames:
            rows = []
            for trial in frame["trial"]:
                rng = np.random.default_rng([seed, int(trial)])
                x = rng.multivariate_normal(model.mu0, model.V0)
                for t in range(steps):
                    drive = model.C @ x + model.d
                    y = np.minimum(rng.poisson(np.exp(np.minimum(drive, np.log(most)))), most) if poisson else drive + rng.standard_normal(len(drive)) * np.sqrt(model.R)
                    rows += [(int(trial), t, i, float(v)) for i, v in enumerate(y)]
                    x = model.A @ x + rng.multivariate_normal(np.zeros(len(x)), model.Q)
            yield pd.DataFrame(rows, columns=["trial", "t", "var", "y"])

    return trials.select("trial").mapInPandas(run, "trial int, t int, var int, y double")
