"""Stochastic identification of a linear system from lagged products, without p x p covariances.

The model says that E y(t + m) y(t)' is C X_m C' (+ diag R at lag 0). The loss is the mean squared difference to the products of pairs of steps over
cells that were seen, half of it, summed over lags. Its gradients need only n-dimensional products of each step with the
loadings. A round draws pairs of steps by a hash, sums the gradients in the tasks and takes an Adam step; its state is appended to a
table, from which a later run goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import lagcov, tasksums
from tessera.sources.store import shared_dir, stored

STATE = "round int, name string, shape array<int>, data array<double>"
NAMES = ("C", "X", "R")


@dataclass
class System:
    """Loadings C [p, n], inner covariances X [lags, n, n] and noise variances R [p]."""

    C: np.ndarray
    X: np.ndarray
    R: np.ndarray


def started(p: int, n: int, lags: int, seed: int = 0, scale: float = 1.0) -> System:
    """Random loadings and states that lose a tenth a step."""
    rng = np.random.default_rng(seed)
    return System(scale * rng.standard_normal((p, n)) / np.sqrt(n), np.stack([0.9**m * np.eye(n) for m in range(lags)]), np.full(p, 1e-3))


def pairs(panel: DataFrame, n_vars: int, lags: int) -> DataFrame:
    """(trial, t, m, now, before) of a panel (trial, t, var, y) less each variable's mean, stored; null where a cell isn't seen."""
    means = panel.groupBy("var").agg(F.avg("y").alias("mean"))
    centred = panel.join(means, "var").select("trial", "t", "var", (F.col("y") - F.col("mean")).alias("y"))
    rows = stored(lagcov.packed(centred, n_vars))
    return stored(lagcov.lagged(rows, lags))


def gradients(s: System, m: int, now: np.ndarray, before: np.ndarray) -> tasksums.Arrays:
    """Sums over pairs of steps at lag m of the loss and its derivatives; NaN cells aren't seen.

    With the residual e = C X C' (+ R) - now before' on the seen cells, rows of now get e C X', those of before e' C X, and X gets C' e C.
    Cells are only ever summed against loadings, so a pair costs p n^2.
    """
    C, X = s.C, s.X[m]
    a, b = np.isfinite(now), np.isfinite(before)
    ya, yb = np.where(a, now, 0.0), np.where(b, before, 0.0)
    n = C.shape[1]
    square = (C[:, :, None] * C[:, None, :]).reshape(len(C), n * n)
    ga, gb = ((on.astype(float) @ square).reshape(-1, n, n) for on in (a, b))  # C'C over the seen rows
    pa_, pb = ya @ C, yb @ C
    left = np.einsum("ij,tjk,lk->til", X, gb, X) - 0.0  # X Gb X'
    right = np.einsum("ji,tjk,kl->til", X, ga, X)  # X' Ga X
    dC = np.einsum("tp,pi,til->pl", a.astype(float), C, left) - ya.T @ (pb @ X.T)
    dC += np.einsum("tp,pi,til->pl", b.astype(float), C, right) - yb.T @ (pa_ @ X)
    dX = np.einsum("tij,jk,tkl->il", ga, X, gb) - pa_.T @ pb
    #: |C X C'|^2 - 2 now' C X C' before + |now|^2 |before|^2 over the seen cells.
    loss = np.einsum("tij,jk,tkl,il->", ga, X, gb, X) - 2 * np.einsum("ti,ij,tj->", pa_, X, pb) + ((ya**2).sum(1) * (yb**2).sum(1)).sum()
    dR = np.zeros_like(s.R)
    if m == 0:
        both = (a & b).sum(0).astype(float)
        own = np.einsum("pi,ij,pj->p", C, X, C)
        product = (ya * yb).sum(0)
        dR = both * (own + s.R) - product
        loss += (both * s.R**2 + 2 * s.R * (both * own - product)).sum()
        noise = (both * s.R)[:, None]
        dC += noise * (C @ X.T + C @ X)
        dX += C.T @ (noise * C)
    every = np.zeros_like(s.X)
    every[m] = dX
    count = np.zeros(len(s.X))
    count[m] = (a.sum(1) * b.sum(1)).sum()
    return {f"C{m}": dC, "X": every, f"R{m}": dR, "loss": np.eye(len(s.X))[m] * loss / 2, "n": count}


def batch(rows: DataFrame, s: System) -> tasksums.Arrays:
    """Loss and gradients over rows of pairs, each lag divided by its seen products; empty without rows."""

    def part(cells: pa.RecordBatch) -> Iterator[tasksums.Arrays]:
        lag = cells.column("m").to_numpy()
        p = len(s.R)
        whole = lambda c: np.array([[np.nan if x is None else x for x in row] for row in cells.column(c).to_pylist()], float).reshape(-1, p)
        now, before = whole("now"), whole("before")
        for m in np.unique(lag):
            yield gradients(s, int(m), now[lag == m], before[lag == m])

    sums = tasksums.summed(rows.select("m", "now", "before"), part)
    if not sums:
        return {}
    per = 1 / np.maximum(sums["n"], 1.0)
    total = lambda name: sum(sums[f"{name}{m}"] * per[m] for m in range(len(per)) if f"{name}{m}" in sums)
    return {"C": total("C"), "X": sums["X"] * per[:, None, None], "R": total("R"), "loss": np.array([(sums["loss"] * per).sum()])}


def fit(rows: DataFrame, start: System, *, rounds: int = 100, batches: int = 4, rate: float = 0.02, decay: float = 0.97, folder: str | None = None, seed: int = 0) -> tuple[System, list[float]]:
    """Adam over mini-batches of pairs of steps; returns the system and each batch's loss before its step.

    In round r those (trial, t) take part whose hash with r falls on 0 of ``batches``; with one batch all do. R stays above 0. rate falls by
    ``decay`` every tenth of the rounds. A folder that holds a table of STATE is gone on from. Rows: what ``pairs`` gives; without
    any the start comes back.
    """
    spark = rows.sparkSession
    folder = folder or shared_dir(spark) + "/descent"
    at, state, trace = _resumed(spark, folder) or (0, {}, [])
    s = System(**{k: state.get(k, getattr(start, k)) for k in NAMES})
    first = {k: state.get(f"m{k}", np.zeros_like(getattr(s, k))) for k in NAMES}
    second = {k: state.get(f"v{k}", np.zeros_like(getattr(s, k))) for k in NAMES}
    for r in range(at, rounds):
        drawn = rows if batches == 1 else rows.where(F.pmod(F.xxhash64("trial", "t", F.lit(seed + r)), F.lit(batches)) == 0)
        g = batch(drawn, s)
        if not g:
            continue
        trace.append(float(g["loss"][0]))
        step = rate * decay ** (10 * r // max(rounds, 1))
        for k in NAMES:
            first[k], second[k] = 0.9 * first[k] + 0.1 * g[k], 0.99 * second[k] + 0.01 * g[k] ** 2
            move = step * (first[k] / (1 - 0.9 ** (r + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (r + 1))) + 1e-12)
            setattr(s, k, getattr(s, k) - move)
        s.R = np.maximum(s.R, 1e-9)
        cells = {k: getattr(s, k) for k in NAMES} | {f"m{k}": first[k] for k in NAMES} | {f"v{k}": second[k] for k in NAMES} | {"loss": np.array(trace)}
        table = [(r + 1, k, list(a.shape), [float(x) for x in a.ravel()]) for k, a in cells.items()]
        spark.createDataFrame(table, STATE).coalesce(1).write.mode("append").parquet(folder)
    return s, trace


def _resumed(spark, folder: str) -> tuple[int, dict[str, np.ndarray], list[float]] | None:
    """The last round of a table of STATE; its size is that of the parameters."""
    try:
        table = spark.read.schema(STATE).parquet(folder)
    except AnalysisException:
        return None
    last = table.agg(F.max("round")).first()[0]
    if last is None:
        return None
    cells = {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in table.where(F.col("round") == last).collect()}
    return last, cells, cells.pop("loss").tolist()
