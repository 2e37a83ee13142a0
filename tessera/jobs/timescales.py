"""Panels whose steps have several lengths: a process in continuous time, dx = M x dt + noise of covariance GG dt, seen at uneven steps.

The move over a step of length dt is A = exp(M dt) with the noise that gathers meanwhile; there is one such pair a length, made once. The number of a
step's length is found as-of in a schedule and travels as its last input, so filter, smoother, segments and sums are those of ``scan``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.jobs import fitting
from tessera.operators import asof, scan, tasksums
from tessera.operators.kalman import Model


@dataclass(frozen=True)
class Timed(Model):
    """A model whose last input is the number of the step's length: A and Q of the move to it are those of ``moves``."""

    moves: tuple[tuple[np.ndarray, np.ndarray], ...] = ()

    def move(self, u: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        return self.moves[0 if u is None else int(u[-1])]


def exponential(m: np.ndarray) -> np.ndarray:
    """exp(m): the power series of m halved until its norm is below a half, squared back as often."""
    halvings = max(0, int(np.ceil(np.log2(max(np.linalg.norm(m, 1), 1e-300)))) + 1)
    small, out, term = m / 2.0**halvings, np.eye(len(m)), np.eye(len(m))
    for k in range(1, 20):
        term = term @ small / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


def propagated(M: np.ndarray, GG: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """A = exp(M dt) and Q, the integral of exp(M s) GG exp(M's) over s from 0 to dt, from one exponential (Van Loan, 1978)."""
    n = len(M)
    both = exponential(np.block([[-M, GG], [np.zeros((n, n)), M.T]]) * dt)
    A = both[n:, n:].T
    Q = A @ both[:n, n:]
    return A, (Q + Q.T) / 2


def timed(model: Model, M: np.ndarray, GG: np.ndarray, dts: list[float]) -> Timed:
    """model with the moves of a process in continuous time over each of the lengths dts; A and Q are those of the first one."""
    moves = tuple(propagated(M, GG, dt) for dt in dts)
    none = np.zeros((len(model.mu0), 1))
    own = {f.name: getattr(model, f.name) for f in fields(Model)}
    return Timed(**{**own, "A": moves[0][0], "Q": moves[0][1], "B": none if model.B is None else np.hstack([model.B, none])}, moves=moves)


def scales(packed: DataFrame, schedule: DataFrame, inputs: DataFrame | None = None, *, block: int = 1_000_000) -> DataFrame:
    """(trial, t, u array): the inputs of each step, none if there are none, and then the number of its length.

    schedule: (trial, t, scale), the number of the length of the moves to step t and those after it, up to the trial's next row; of
    rows at one step the largest counts. Steps before a trial's first row take that row's length, trials without rows length 0. Each
    length is noted again at every block of steps, so a long trial is looked up by many tasks. inputs (trial, t, u array) must
    have a row for each step.
    """
    ends = packed.groupBy("trial").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    marks = schedule.where("scale IS NOT NULL").groupBy("trial", "t").agg(F.max("scale").alias("scale")).join(ends, "trial")
    order = W.partitionBy("trial").orderBy("t")  # one row a change of length
    last = F.coalesce(F.lead("t").over(order) - 1, F.greatest("b", "t"))
    first = F.when(F.row_number().over(order) == 1, F.least("t", "a")).otherwise(F.col("t"))
    marks = marks.select("trial", first.alias("t"), last.alias("z"), "scale").where("t <= z")
    number = lambda c: F.floor(F.col(c).cast("long") / block)
    marks = marks.select("trial", "t", "scale", F.explode(F.sequence(number("t"), number("z"))).alias("block"))
    marks = marks.select("trial", "block", F.greatest(F.col("t").cast("long"), F.col("block") * block).cast("int").alias("t"), F.col("scale").cast("double").alias("scale"))
    steps = packed.select("trial", "t", number("t").alias("block"))
    found = asof.as_of(steps, marks, ["trial", "block"], "t", "scale", "scale").select("trial", "t", F.array(F.coalesce("scale", F.lit(0.0))).alias("scale"))
    if inputs is None:
        return found.withColumnRenamed("scale", "u")
    return found.join(inputs.select("trial", "t", "u"), ["trial", "t"]).select("trial", "t", F.concat("u", "scale").alias("u"))


def posterior(packed: DataFrame, schedule: DataFrame, model: Timed, *, steps: int = 1000, inputs: DataFrame | None = None) -> DataFrame:
    """``scan.posterior`` under a schedule of step lengths."""
    return scan.posterior(packed, model, steps=steps, inputs=scales(packed, schedule, inputs))


def e_step(rows: DataFrame, model: Timed) -> tasksums.Arrays:
    """The sums of ``fitting.e_step`` for segments whose last input is the length's number, and those of the moves by length (past0, past1, ...)."""
    kinds = np.arange(len(model.d))

    def part(batch: pa.RecordBatch) -> Iterator[tasksums.Arrays]:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            (y, u), found = scan.cells(row, model), scan.finished(row, model)
            yield fitting.segment_statistics(model, y, None, kinds, found)
            xs, vs, cross, _, past = found
            if past is not None:
                xs, vs = np.vstack([past[0][None], xs]), np.concatenate([past[1][None], vs])
            own = len(xs) - len(y)  # 1 where a step comes before the segment
            e, lengths = vs + xs[:, :, None] * xs[:, None, :], u[1 - own :, -1].astype(int)
            lag = cross[1 - own :] + xs[1:, :, None] * xs[:-1, None, :]
            for s in np.unique(lengths):
                on = lengths == s
                yield {f"past{s}": e[:-1][on].sum(0), f"next{s}": e[1:][on].sum(0), f"lag{s}": lag[on].sum(0), f"steps{s}": np.array([[float(on.sum())]])}

    return tasksums.summed(scan.framed(rows, model), part)


def m_step(s: tasksums.Arrays, old: Timed) -> Timed:
    """Parameters in closed form, a move for each length that was met; the others keep theirs."""
    new, n = fitting.m_step(s, _plain(old)), len(old.mu0)
    moves = list(old.moves)
    for k in range(len(moves)):
        if f"steps{k}" in s:
            past, lag = s[f"past{k}"], s[f"lag{k}"]
            A = np.linalg.lstsq(past.T, lag.T, rcond=None)[0].T
            Q = (s[f"next{k}"] - A @ lag.T - lag @ A.T + A @ past @ A.T) / s[f"steps{k}"][0, 0]
            moves[k] = A, (Q + Q.T) / 2 + 1e-12 * np.eye(n)
    return replace(old, mu0=new.mu0, V0=new.V0, C=new.C, d=new.d, R=new.R, A=moves[0][0], Q=moves[0][1], moves=tuple(moves))


def _plain(model: Timed) -> Model:
    """The model of the first length alone, without inputs."""
    return Model(model.A, model.Q, model.mu0, model.V0, model.C, model.d, model.R)


def fit(packed: DataFrame, schedule: DataFrame, start: Timed, rounds: int = 10, gain: float = 1e-6, *, segment: int = 1000) -> tuple[Timed, list[float]]:
    """Expectation maximisation in which each step length has its own A and Q, until the log-likelihood gains less than ``gain``.

    The lengths' number is that of the model's moves. A panel without rows gives the start model and no trace. Models with further inputs are refused.
    """
    if start.B is None or start.B.shape[1] != 1:
        raise ValueError("a fit by step lengths takes no further inputs")
    rows, model, trace = scan.chunks(packed, segment, scales(packed, schedule)), start, []
    while len(trace) < rounds and not (len(trace) > 1 and trace[-1] - trace[-2] <= gain):
        s = e_step(rows, model)
        if not s:
            break
        trace.append(float(s["ll"][0, 0]))
        model = m_step(s, model)
    return model, trace
