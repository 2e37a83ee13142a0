"""Rates of low rank behind counts: the least of sum f(L) - y log f(L) + lam ||L - mean over time||_*, by alternating directions.

Rows are steps, columns variables. A row keeps its counts, its rates x and its multipliers z between rounds, in one of two tables that take turns. A round is

1. the sum of v and of v v' over all rows, v = x + z / rho: p numbers and p x p ones, which tasks add up;
2. on the driver, the eigenvectors of the centred p x p sum and from them the p x p matrix W that shrinks singular values by lam / rho;
3. in each row L = mean + (v - mean) W, z + rho (x - L), and new rates, a convex problem of one unknown in each cell.

So no matrix of all steps is ever put together, and only sums of the size of a covariance reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import kalman, lagcov, tasksums
from tessera.sources.store import shared_dir, shared_out

_STATE = "trial int, t int, y array<double>, x array<double>, z array<double>, primal double, dual double, scale double, loss double"


@dataclass(frozen=True)
class Link:
    """A rate f, its logarithm, the first two derivatives of f(x) - y log f(x), where that is least for counts, and first values for them."""

    rate: Callable[[np.ndarray], np.ndarray]
    log_rate: Callable[[np.ndarray], np.ndarray]
    slopes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    least: Callable[[np.ndarray], np.ndarray]
    start: Callable[[np.ndarray], np.ndarray]


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def _log_softplus(x: np.ndarray) -> np.ndarray:
    return np.where(x < -30, x, np.log(_softplus(np.maximum(x, -30))))


def _softplus_slopes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up = np.exp(-np.logaddexp(0.0, -x))  # the derivative of softplus
    ratio = np.exp(-np.logaddexp(0.0, -x) - _log_softplus(x))  # and that of its logarithm
    return up - y * ratio, up * (1 - up) + y * np.maximum(ratio * (ratio - 1 + up), 0.0)


def _exp(x: np.ndarray) -> np.ndarray:
    return np.exp(np.minimum(x, 500.0))


LINKS = {
    "exp": Link(_exp, lambda x: x, lambda x, y: (_exp(x) - y, _exp(x)), lambda y: np.log(np.maximum(y, 1e-300)), lambda y: np.log(np.maximum(y, 1.0))),
    "softplus": Link(_softplus, _log_softplus, _softplus_slopes, lambda y: y + np.log(np.maximum(-np.expm1(-y), 1e-300)), lambda y: np.maximum(y - 1.0, 0.0)),
}


def nearest(link: Link, y: np.ndarray, target: np.ndarray, rho: float, *, rounds: int = 100) -> np.ndarray:
    """In each cell the least of f(x) - y log f(x) + rho / 2 (x - target)^2; the target itself where y is NaN.

    The slope grows with x and vanishes between the target and the cell's own least, no farther off than the target's slope over rho. Newton
    steps that leave this bracket, which narrows each round, or are longer than half the step before give way to its middle.
    """
    seen = np.isfinite(y)
    counts, x = np.where(seen, y, 0.0), target.copy()
    slope = np.where(seen, link.slopes(x, counts)[0], 0.0)
    far = np.where(seen, link.least(counts), target)
    far = np.where(slope > 0, np.maximum(far, x - slope / rho), np.minimum(far, x - slope / rho))
    low, high = np.minimum(x, far), np.maximum(x, far)
    last = high - low
    for _ in range(rounds):
        g, h = link.slopes(x, counts)
        g = np.where(seen, g, 0.0) + rho * (x - target)
        low, high = np.where(g < 0, x, low), np.where(g > 0, x, high)
        step = x - g / (np.where(seen, h, 0.0) + rho)
        good = (step >= low) & (step <= high) & (np.abs(step - x) <= last / 2)
        new = np.where(good | (g == 0), np.where(g == 0, x, step), (low + high) / 2)
        last, x = np.abs(new - x), new
        if (last <= 1e-14 * (1 + np.abs(x))).all():
            break
    return x


@dataclass(frozen=True)
class Shrunk:
    """Offsets by variable and what is left of the rows' covariance: vectors by column, singular values, W = shrunk over all steps."""

    offset: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    W: np.ndarray


@dataclass(frozen=True)
class Fit:
    """rates (trial, t, x array by variable), offsets and components, steps, and by round the objective and both residuals over their tolerance.

    A variable without a count has rates of minus infinity, one that was never seen NaN; neither takes part (``kept`` lists the others).
    """

    rates: DataFrame
    kept: list[int]
    shrunk: Shrunk
    steps: int
    trace: list[tuple[float, float, float]]


def _cells(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.float64()))


def _sums(rho: float) -> Callable[[pa.RecordBatch], list[tasksums.Arrays]]:
    def part(batch: pa.RecordBatch) -> list[tasksums.Arrays]:
        v = _cells(batch, "x") + _cells(batch, "z") / rho
        marks = np.array([np.sum(batch.column(c).to_numpy()) for c in ("primal", "dual", "scale", "loss")])
        return [{"n": np.array([len(v)]), "v": v.sum(0), "vv": v.T @ v, "marks": marks}] if len(v) else []

    return part


def shrink(n: float, v: np.ndarray, vv: np.ndarray, by: float) -> Shrunk:
    """Singular values of n rows less ``by``, from the rows' sum and that of their products."""
    offset = v / n
    squares, vectors = np.linalg.eigh(vv - n * np.outer(offset, offset))
    sizes, vectors = np.sqrt(np.maximum(squares[::-1], 0.0)), vectors[:, ::-1]
    left = np.maximum(sizes - by, 0.0)
    share = np.divide(left, sizes, out=np.zeros_like(left), where=sizes > 0)
    return Shrunk(offset, vectors, left, (vectors * share) @ vectors.T)


def _turned(state: DataFrame, link: Link, s: Shrunk, rho: float, following: float) -> DataFrame:
    """The rows of the next round; ``following`` is its rho."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y, x, z = (_cells(batch, c) for c in "yxz")
            low = s.offset + (x + z / rho - s.offset) @ s.W
            z = z + rho * (x - low)
            seen = np.isfinite(y)
            counts = np.where(seen, y, 0.0)
            slope = np.where(seen, link.slopes(x, counts)[0], 0.0) + z
            loss = np.where(seen, link.rate(low) - counts * link.log_rate(low), 0.0).sum(1)
            gap = ((x - low) ** 2).sum(1)
            new = nearest(link, y, low - z / following, following)
            yield pa.record_batch([batch.column("trial"), batch.column("t"), batch.column("y"), _lists(new), _lists(z), pa.array(gap), pa.array((slope**2).sum(1)), pa.array((z**2).sum(1)), pa.array(loss)], [c.split()[0] for c in _STATE.split(", ")])

    return state.mapInArrow(run, _STATE)


def _begun(rows: DataFrame, link: Link, kept: list[int], rho: float) -> DataFrame:
    """First rows: no multipliers, rates from the counts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = _cells(batch, "y")[:, kept]
            x = np.where(np.isfinite(y), link.start(np.where(np.isfinite(y), y, 0.0)), 0.0)
            none = pa.array(np.zeros(len(y)))
            yield pa.record_batch([batch.column("trial"), batch.column("t"), _lists(y), _lists(x), _lists(np.zeros_like(x)), none, none, none, none], [c.split()[0] for c in _STATE.split(", ")])

    return rows.mapInArrow(run, _STATE)


def _rates(state: DataFrame, s: Shrunk, rho: float, kept: list[int], rest: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = np.tile(rest, (batch.num_rows, 1))
                out[:, kept] = s.offset + (_cells(batch, "x") + _cells(batch, "z") / rho - s.offset) @ s.W
                yield pa.record_batch([batch.column("trial"), batch.column("t"), _lists(out)], ["trial", "t", "x"])

    return state.mapInArrow(run, "trial int, t int, x array<double>")


def fit(panel: DataFrame, n_vars: int, *, strength: float = 1.0, link: str = "softplus", rho: float = 1.3, eps_abs: float = 1e-6, eps_rel: float = 1e-3, rounds: int = 250) -> Fit:
    """Rates for a panel (trial, t, var, y) of counts over every step between a trial's first and last one.

    lam is ``strength`` times the root of the number of cells. Null cells aren't seen: they add no loss. Rounds end when both residuals are
    within tolerance; rho doubles or halves while one residual is ten times the other, in the first half of the rounds. Two tables of
    two numbers a cell are all that is kept. An empty panel, or one without counts, gives no rows and no rounds.
    """
    made, spark = LINKS[link], panel.sparkSession
    rows = lagcov.packed(panel, n_vars, every_step=True).select(F.col("trial").cast("int").alias("trial"), F.col("t").cast("int").alias("t"), "y")
    totals = {r["var"]: r["total"] for r in panel.where("y IS NOT NULL").groupBy("var").agg(F.sum(F.col("y").cast("double")).alias("total")).collect()}  # one row a variable
    kept = [v for v in range(n_vars) if totals.get(v, 0) > 0]
    rest = np.array([-np.inf if v in totals else np.nan for v in range(n_vars)])
    p = len(kept)
    if not kept:
        none = Shrunk(np.zeros(0), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
        return Fit(rows.limit(0).withColumnRenamed("y", "x"), [], none, 0, [])
    folders, trace = [shared_dir(spark), shared_dir(spark)], []

    def kept_in(k: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(folders[k % 2])
        return spark.read.schema(_STATE).parquet(folders[k % 2])

    #: A round's tasks are those of the files that it reads, so the first rows are dealt out: packed rows are few bytes and would all be in one.
    state, lam, value = kept_in(0, _begun(shared_out(rows, "trial", "t"), made, kept, rho)), 0.0, 0.0
    for k in range(rounds + 1):
        got = tasksums.summed(state, _sums(rho))
        n = float(got["n"][0])
        lam, following = strength * np.sqrt(n * p), rho
        if k:
            primal, dual, scale = np.sqrt(got["marks"][:3])
            allowed = np.sqrt(n * p) * eps_abs
            over = primal / (allowed + eps_rel * np.sqrt((s.values**2).sum())), dual / (allowed + eps_rel * scale)
            trace.append((float(got["marks"][3] + value), float(over[0]), float(over[1])))
            if k <= rounds // 2:
                following = rho * 2 if primal > 10 * dual else rho / 2 if dual > 10 * primal else rho
        s = shrink(n, got["v"], got["vv"], lam / rho)
        value = lam * s.values.sum()
        if k == rounds or (k and max(over) <= 1):
            break
        state, rho = kept_in(k + 1, _turned(state, made, s, rho, following)), following
    return Fit(_rates(state, s, rho, kept, rest), kept, s, int(n), trace)


def start_model(made: Fit, n: int) -> kalman.Model:
    """A system for the kept variables from the first n components: states of unit variance, dynamics by regression on the step before.

    Components beyond the rates' rank have no loadings. Only sums of n x n numbers are collected.
    """
    v, values = made.shrunk.vectors[:, :n], made.shrunk.values[:n]
    per = np.divide(np.sqrt(made.steps), values, out=np.zeros_like(values), where=values > 0)
    kept, offset = made.kept, made.shrunk.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = (_cells(batch, "x")[:, kept] - offset) @ v * per
                yield pa.record_batch([batch.column("trial"), batch.column("t"), _lists(x)], ["trial", "t", "x"])

    states = made.rates.mapInArrow(run, "trial int, t int, x array<double>")
    before = states.select("trial", (F.col("t") + 1).alias("t"), F.col("x").alias("past"))

    def part(batch: pa.RecordBatch) -> list[tasksums.Arrays]:
        x, past = _cells(batch, "x"), _cells(batch, "past")
        return [{"pp": past.T @ past, "xp": x.T @ past, "xx": x.T @ x, "n": np.array([len(x)])}] if len(x) else []

    got = tasksums.summed(states.join(before, ["trial", "t"]), part)
    if not got:
        raise ValueError("no trial has two steps")
    A = got["xp"] @ np.linalg.pinv(got["pp"])
    Q = (got["xx"] - A @ got["xp"].T) / got["n"][0]
    return kalman.Model(A, (Q + Q.T) / 2 + 1e-9 * np.eye(n), np.zeros(n), np.eye(n), v * values / np.sqrt(made.steps), offset, np.ones(len(kept)))
