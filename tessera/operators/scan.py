"""Smoothing of trials of any length by segments: a trial's steps are spread over tasks.

Steps are cut into segments of one row each. What a segment does to the state before it is an associative map (Sarkka and
Garcia-Fernandez, 2021): the maps of a trial's segments, a few n x n matrices each, are combined from its start to its end, which gives
every segment the filtered state that it begins with. Going back, each segment's smoothing kernels are composed likewise, which gives it the
smoothed state of its last step. Then all segments are finished at once. The result is that of the serial recursion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.kalman import Model, State, smoothed_segment
from tessera.sources.store import stored

#: A forward map: x -> A x + b with noise C, and the likelihood of what was seen as information J and vector eta about x.
Forward = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: A backward map: E x + g with noise L.
Backward = tuple[np.ndarray, np.ndarray, np.ndarray]


TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _t(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def _on(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a x, also for many of them."""
    return (a @ x[..., None])[..., 0]


def then(a: Forward, b: Forward) -> Forward:
    """The map of steps a, then b; also for many of them, along leading axes."""
    (A1, b1, C1, e1, J1), (A2, b2, C2, e2, J2) = a, b
    eye = np.eye(b1.shape[-1])
    left = _t(np.linalg.solve(_t(eye + C1 @ J2), _t(A2)))  # A2 (I + C1 J2)^-1
    right = _t(np.linalg.solve(_t(eye + J2 @ C1), A1))  # A1' (I + J2 C1)^-1
    C = left @ C1 @ _t(A2) + C2
    J = right @ J2 @ A1 + J1
    return left @ A1, _on(left, b1 + _on(C1, e2)) + b2, (C + _t(C)) / 2, _on(right, e2 - _on(J2, b1)) + e1, (J + _t(J)) / 2


def _moves(model: Model, u: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A, Q and drift of the moves to steps with inputs u, one a segment; A and Q are single ones if no input changes them."""
    if u is None:
        return *model.move(None), model.drift(None)
    drift = u @ model.B.T if model.B is not None else np.zeros(len(model.mu0))
    if type(model).move is Model.move:
        return model.A, model.Q, drift
    A, Q = zip(*(model.move(x) for x in u), strict=True)
    return np.array(A), np.array(Q), drift


def _seen(model: Model, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Information about the states behind cells y [segments, p] and pull of what they hold beyond states m; and whether any is seen."""
    on = np.isfinite(y)
    weights = on / model.R
    n = len(model.mu0)
    squares = (model.C[:, :, None] * model.C[:, None, :]).reshape(-1, n * n)
    e = np.where(on, y - model.d - m @ model.C.T, 0.0)
    return (weights @ squares).reshape(-1, n, n), (weights * e) @ model.C, on.any(axis=1)


def forward_maps(model: Model, y: np.ndarray, u: np.ndarray | None, first: np.ndarray) -> Forward:
    """The maps of segments of equal length: y [segments, steps, p] (NaN unseen), u [segments, steps, m].

    first: the places of their first steps in their trials. All segments take a step at once.
    """
    n, out = len(model.mu0), None
    eye, begins = np.eye(n), np.asarray(first) == 0
    for k in range(y.shape[1]):
        F_, Q, drift = _moves(model, None if u is None else u[:, k])
        F_, Q = (np.broadcast_to(a, (len(y), n, n)) for a in (F_, Q))
        drift = np.broadcast_to(drift, (len(y), n))
        if k == 0:
            at = begins[:, None]
            F_, Q, drift = np.where(at[..., None], 0.0, F_), np.where(at[..., None], model.V0, Q), np.where(at, model.mu0, drift)
        G, w, any_seen = _seen(model, y[:, k], drift)
        seen = np.linalg.inv(eye + Q @ G)  # I - K C
        info = np.linalg.solve(eye + G @ Q, np.concatenate([G, w[..., None]], axis=-1))
        C = np.where(any_seen[:, None, None], seen @ Q, Q)
        J = _t(F_) @ info[..., :n] @ F_
        one = (seen @ F_, drift + _on(C, w), (C + _t(C)) / 2, _on(_t(F_), info[..., n]), (J + _t(J)) / 2)
        out = one if out is None else then(out, one)
    return out


def filtered_segments(model: Model, y: np.ndarray, u: np.ndarray | None, first: np.ndarray, before: State) -> tuple[np.ndarray, ...]:
    """``kalman.filtered`` for segments of equal length; before [segments, n] and [segments, n, n] doesn't count where first is 0."""
    size, steps, p = y.shape
    n = len(model.mu0)
    m, mu = np.zeros((2, steps, size, n))
    P, v = np.zeros((2, steps, size, n, n))
    ll, eye, begins = np.zeros((steps, size)), np.eye(n), (np.asarray(first) == 0)[:, None]
    for k in range(steps):
        past = (mu[k - 1], v[k - 1]) if k else before
        A, Q, drift = _moves(model, None if u is None else u[:, k])
        m[k], P[k] = _on(A, past[0]) + drift, A @ past[1] @ _t(A) + Q
        if k == 0:
            m[k], P[k] = np.where(begins, model.mu0, m[k]), np.where(begins[..., None], model.V0, P[k])
        G, w, any_seen = _seen(model, y[:, k], m[k])
        gain = np.linalg.inv(G + np.linalg.inv(P[k]))
        mu[k] = m[k] + _on(gain, w)
        v[k] = np.where(any_seen[:, None, None], (gain + _t(gain)) / 2, P[k])
        on = np.isfinite(y[:, k])
        e = np.where(on, y[:, k] - model.d - m[k] @ model.C.T, 0.0)
        det = np.linalg.slogdet(eye + G @ P[k])[1]
        ll[k] = -0.5 * ((e * e / model.R).sum(1) - (w * _on(gain, w)).sum(1) + on @ np.log(model.R) + det + on.sum(1) * np.log(2 * np.pi))
    return m, P, mu, v, ll


def backward_maps(model: Model, u: np.ndarray | None, before: State, found: tuple[np.ndarray, ...]) -> Backward:
    """The maps from the smoothed states of segments' last steps to those of the steps before their first ones; found: as filtered."""
    m, P, mu, v, _ = found
    n = m.shape[-1]
    E, g, L = np.broadcast_to(np.eye(n), P[0].shape), np.zeros_like(m[0]), np.zeros_like(P[0])
    for k in range(len(m) - 1, -1, -1):
        past = (mu[k - 1], v[k - 1]) if k else before
        A, _, _ = _moves(model, None if u is None else u[:, k])
        e = _t(np.linalg.solve(_t(P[k]), A @ _t(past[1])))
        E, g, L = e @ E, _on(e, g) + past[0] - _on(e, m[k]), e @ L @ _t(e) + past[1] - e @ P[k] @ _t(e)
    return E, g, (L + _t(L)) / 2


def smoothed_segments(model: Model, u: np.ndarray | None, first: np.ndarray, before: State, after: State, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Smoothed means, covariances and covariances with the step before, [steps, segments, ...]; after: the last steps' smoothed states."""
    m, P, mu, v, _ = found
    xs, vs, cross = mu.copy(), v.copy(), np.zeros_like(v)
    xs[-1], vs[-1] = after
    for k in range(len(m) - 1, -1, -1):
        past = (mu[k - 1], v[k - 1]) if k else before
        A, _, _ = _moves(model, None if u is None else u[:, k])
        j = past[1] @ _t(A) @ np.linalg.inv(P[k])
        cross[k] = vs[k] @ _t(j)
        if k:
            xs[k - 1] = past[0] + _on(j, xs[k] - m[k])
            vs[k - 1] = past[1] + j @ (vs[k] - P[k]) @ _t(j)
    cross[0][np.asarray(first) == 0] = 0.0
    return xs, vs, cross


def chunks(packed: DataFrame, steps: int = 1000, inputs: DataFrame | None = None) -> DataFrame:
    """(trial, seg, first, t, y, u): the steps of a packed panel (trial, t, y array) by segments of ``steps``, stored.

    first: the place of a segment's first step in its trial; u: the inputs (trial, t, u array) of its steps, null without any. A step
    without input counts as one with zeros. The panel must hold every step of a trial's span.
    """
    rows = packed.select("trial", "t", "y")
    rows = rows.join(inputs.select("trial", "t", "u"), ["trial", "t"], "left") if inputs is not None else rows.withColumn("u", F.lit(None).cast("array<double>"))
    rows = rows.join(packed.groupBy("trial").agg(F.min("t").alias("start")), "trial")
    place = F.col("t").cast("long") - F.col("start")
    cut = rows.groupBy("trial", F.floor(place / steps).alias("seg")).agg(F.min(place).alias("first"), F.sort_array(F.collect_list(F.struct("t", "y", "u"))).alias("s"))
    return stored(cut.select("trial", "seg", "first", F.col("s.t").alias("t"), F.col("s.y").alias("y"), F.col("s.u").alias("u")))


def cells(row: dict, model: Model) -> tuple[np.ndarray, np.ndarray | None]:
    """Observations [steps, p] and inputs [steps, m] of a row of chunks."""
    y = np.array([[np.nan if x is None else x for x in step] for step in row["y"]], float).reshape(len(row["t"]), len(model.d))
    if model.B is None:
        return y, None
    none = [0.0] * model.B.shape[1]
    return y, np.array([none if x is None else x for x in row["u"]], float)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """[steps, width] of a column of lists of lists without null lists among them; null cells are NaN."""
    inner = column.flatten()
    if inner.null_count or len(inner.flatten()) != len(inner) * width:
        raise ValueError(f"a step has other than {width} cells")
    return inner.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def grouped(batch: pa.RecordBatch, model: Model, cells_at_once: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray | None]]:
    """Rows of chunks by their numbers of steps, with observations [segments, steps, p] and inputs [segments, steps, m].

    At most about cells_at_once cells are laid out together.
    """
    p, counts = len(model.d), np.array([len(x) for x in batch.column("t")], int)
    for steps in np.unique(counts):
        places, size = np.flatnonzero(counts == steps), max(1, cells_at_once // max(1, int(steps) * p))
        for at in range(0, len(places), size):
            rows = batch.take(pa.array(places[at : at + size]))
            y, u = _matrix(rows.column("y"), p).reshape(rows.num_rows, steps, p), None
            if model.B is not None:
                none = [0.0] * model.B.shape[1]
                u = np.array([[none if x is None else x for x in row] for row in rows.column("u").to_pylist()], float).reshape(rows.num_rows, steps, -1)
            yield rows, y, u


def states(column: pa.Array, n: int) -> State:
    """Means and covariances from a column of flat ones; where it is null, none and the identity."""
    none = _flat(np.zeros(n), np.eye(n))
    flat = np.array([none if x is None else x for x in column.to_pylist()], float).reshape(len(column), -1)
    return flat[:, :n], flat[:, n:].reshape(-1, n, n)


def each(rows: DataFrame, schema: str, run: Callable[[pa.RecordBatch], Iterator[tuple]]) -> DataFrame:
    """What ``run`` makes of each batch, as columns of ``schema``."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for made in run(batch):
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, TYPES[kind]) for c, kind in zip(made, kinds, strict=True)], names)

    return rows.mapInArrow(over, schema)


def _listed(*arrays: np.ndarray) -> pa.Array:
    """Rows of arrays [rows, ...], laid flat one behind the other."""
    flat = np.concatenate([a.reshape(len(a), -1) for a in arrays], axis=1)
    return pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float64()))


def _flat(*arrays: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ravel(a) for a in arrays])


def _unflat(data: list[float], *shapes: tuple[int, ...]) -> list[np.ndarray]:
    out, at, flat = [], 0, np.asarray(data, float)
    for s in shapes:
        size = int(np.prod(s))
        out.append(flat[at : at + size].reshape(s))
        at += size
    return out


def befores(rows: DataFrame, model: Model) -> DataFrame:
    """(trial, seg, before): the filtered mean and covariance, flat, of the step before each segment of chunks; null for the first one."""
    n = len(model.mu0)
    shapes = ((n, n), (n,), (n, n), (n,), (n, n))

    def up(batch: pa.RecordBatch) -> Iterator[tuple]:
        for some, y, u in grouped(batch, model):
            yield some.column("trial"), some.column("seg"), _listed(*forward_maps(model, y, u, some.column("first").to_numpy()))

    def along(frame: pd.DataFrame) -> pd.DataFrame:
        frame, total, out = frame.sort_values("seg"), None, []
        for data in frame["map"]:
            out.append(None if total is None else _flat(total[1], total[2]))
            one = tuple(_unflat(data, *shapes))
            total = one if total is None else then(total, one)
        return pd.DataFrame({"trial": frame["trial"], "seg": frame["seg"], "before": out})

    maps = each(rows.where(F.col("seg") < F.col("last")), "trial int, seg long, map array<double>", up)
    #: One row a segment, n^2 numbers each.
    held = maps.unionByName(rows.where(F.col("seg") == F.col("last")).select("trial", "seg", F.array(*[F.lit(0.0)] * sum(int(np.prod(s)) for s in shapes)).alias("map")))
    return held.groupBy("trial").applyInPandas(along, "trial int, seg long, before array<double>")


def afters(rows: DataFrame, model: Model) -> DataFrame:
    """(trial, seg, after): the smoothed mean and covariance, flat, of each segment's last step; rows hold ``before``."""
    n = len(model.mu0)
    state = ((n,), (n, n))

    def down(batch: pa.RecordBatch) -> Iterator[tuple]:
        for some, y, u in grouped(batch, model):
            before = states(some.column("before"), n)
            found = filtered_segments(model, y, u, some.column("first").to_numpy(), before)
            maps, ends = _listed(*backward_maps(model, u, before, found)), _listed(found[2][-1], found[3][-1])
            starts, ended = some.column("before").is_null(), pc.equal(some.column("seg"), some.column("last"))
            none = pa.nulls(len(starts), TYPES["array<double>"])
            yield some.column("trial"), some.column("seg"), pc.if_else(starts, none, maps), pc.if_else(ended, ends, none)

    def along(frame: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values("seg", ascending=False), []
        x, v = _unflat(frame["ends"].iloc[0], *state)
        for data in frame["map"]:
            out.append(_flat(x, v))
            if data is not None:
                E, g, L = _unflat(data, (n, n), (n,), (n, n))
                x, v = E @ x + g, E @ v @ E.T + L
        return pd.DataFrame({"trial": frame["trial"], "seg": frame["seg"], "after": out})

    maps = each(rows, "trial int, seg long, map array<double>, ends array<double>", down)
    return maps.groupBy("trial").applyInPandas(along, "trial int, seg long, after array<double>")


def framed(rows: DataFrame, model: Model) -> DataFrame:
    """Chunks with ``last`` (their trial's last segment), ``before`` and ``after``; the latter are null for trials of one segment."""
    rows = rows.join(rows.groupBy("trial").agg(F.max("seg").alias("last")), "trial")
    none = F.lit(None).cast("array<double>")
    single, several = rows.where("last = 0").withColumns({"before": none, "after": none}), rows.where("last > 0")
    if several.isEmpty():
        return single
    several = several.join(stored(befores(several, model)), ["trial", "seg"])
    several = several.join(stored(afters(several, model)), ["trial", "seg"])
    return several.select(*single.columns).unionByName(single)


def finished(row: dict, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, State | None]:
    """Smoothed means, covariances, covariances with the step before, the steps' log-likelihood, and the smoothed state before the segment."""
    n = len(model.mu0)
    y, u = cells(row, model)
    state = lambda c: tuple(_unflat(row[c], (n,), (n, n))) if row[c] is not None else None
    return smoothed_segment(model, y, u, state("before"), state("after"))


def posterior(packed: DataFrame, model: Model, *, steps: int = 1000, inputs: DataFrame | None = None) -> DataFrame:
    """(trial, t, x, v, vv, loglik) per step of a packed panel, as ``kalman.posterior`` has them; loglik is that of a segment, at its first step.

    A trial of T steps takes T / steps tasks' work; what goes through one task a trial is one map of a few n x n matrices a
    segment.
    """
    rows = framed(chunks(packed, steps, inputs), model)

    n = len(model.mu0)

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for some, y, u in grouped(batch, model):
            first, before = some.column("first").to_numpy(), states(some.column("before"), n)
            found = filtered_segments(model, y, u, first, before)
            after, open_end = states(some.column("after"), n), some.column("after").is_null().to_numpy(zero_copy_only=False)
            after = tuple(np.where(open_end.reshape(-1, *[1] * (x.ndim - 1)), ends[-1], x) for x, ends in zip(after, found[2:4], strict=True))
            by_row = [np.swapaxes(a, 0, 1).reshape(y.shape[0] * y.shape[1], -1) for a in smoothed_segments(model, u, first, before, after, found)]
            ll = np.zeros(y.shape[:2])
            ll[:, 0] = found[4].sum(0)
            yield pa.array(np.repeat(some.column("trial").to_numpy(), y.shape[1])), some.column("t").flatten(), *map(_listed, by_row), pa.array(ll.ravel())

    return each(rows, "trial int, t int, x array<double>, v array<double>, vv array<double>, loglik double", run)
