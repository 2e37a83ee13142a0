"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X stay where they are. A step multiplies them by a right vector and, in the same pass, the result by the rows
again: X v gives the next left vector, X'u the next right one. Left vectors have an entry a row, so they are never kept:
tasks derive those of their own rows anew from the right vectors and the coefficients found so far, which makes
every pass a scan that any lost executor can repeat. Both families are orthogonalised against all their predecessors. Right
vectors have the length of an embedding and lie on the driver, as does the small bidiagonal matrix whose singular value
decomposition gives components and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, stored, tidy

#: Rows that a task works on at once.
BLOCK = 4096
#: The largest magnitude of an entry before scaling whose long is exact.
LARGEST = float(1 << 42)


def fixed_point(embeddings: DataFrame, *, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, x array<long>): floor(scale c) + shift of each entry, stored.

    Rows go whose vector is null, empty, or holds null, NaN, infinite entries or such of a magnitude above 2^42, and rows of another length than
    most others (of equally frequent lengths the longest counts).
    """
    c = F.col("embedding")
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= LARGEST))
    rows = embeddings.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), c)
    usual = rows.groupBy(F.size(c).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size(c) == (usual["d"] if usual else 0))
    return small_batches(stored(rows.select("vec_id", F.transform(c, lambda e: F.floor(e.cast("double") * scale) + shift).alias("x"))))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """[rows, d] of a batch's column x."""
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def summed(rows: DataFrame, part: Callable[[np.ndarray], list[np.ndarray]], merge: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]) -> list[np.ndarray] | None:
    """Arrays that ``part`` makes of each block of rows, put together by ``merge`` in the tasks and then over tasks; None without rows.

    Tasks' results have the size of a few vectors. Where tasks are many they are merged by some tasks more before they come back.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                made = part(matrix(batch.slice(at, BLOCK)))
                held = made if held is None else merge(held, made)
        yield from packed(held)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for cells in batch.column("a").to_pylist():
                made = [np.frombuffer(a, kind).reshape(shape) for a, kind, shape in ((c["data"], c["kind"], c["shape"]) for c in cells)]
                held = made if held is None else merge(held, made)
        yield from packed(held)

    def packed(arrays: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if arrays is not None:
            yield pa.record_batch([pa.array([[{"data": a.tobytes(), "kind": a.dtype.str, "shape": list(a.shape)} for a in arrays]], pa.list_(pa.struct([("data", pa.binary()), ("kind", pa.string()), ("shape", pa.list_(pa.int32()))])))], ["a"])

    schema = "a array<struct<data: binary, kind: string, shape: array<int>>>"
    results = rows.select("x").mapInArrow(tidy(one), schema)
    tasks = rows.rdd.getNumPartitions()
    if tasks > 256:
        results = results.repartition(round(tasks**0.5)).mapInArrow(again, schema)
    held = None
    for row in results.collect():
        made = [np.frombuffer(bytes(c["data"]), c["kind"]).reshape(c["shape"]) for c in row["a"]]
        held = made if held is None else merge(held, made)
    return held


def added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


@dataclass
class Basis:
    """Right vectors V [d, k + 1] and the upper triangle T [k, k] with X V_k = U T; U has orthonormal columns."""

    V: np.ndarray
    T: np.ndarray

    def left(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The left vectors' entries of centred rows x, and X v of the newest right vector."""
        k = len(self.T)
        w = x @ self.V
        u = np.zeros((len(x), k))
        for j in range(k):
            u[:, j] = (w[:, j] - u[:, :j] @ self.T[:j, j]) / self.T[j, j]
        return u, w[:, k]


def bidiagonalised(rows: DataFrame, mean: np.ndarray, *, wanted: int, precise: float = 1e-15, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right vectors V [d, k], the coefficients T [k, k] with X V = U T, and the norm of what is left over of each X'u.

    One pass a step, and another one where rounding has left more than a trace of earlier left vectors. Steps end when the
    first ``wanted`` singular vectors have settled to rounding, when X has no direction left, or at d steps, where the result is exact.
    """
    d = len(mean)
    rng = np.random.default_rng(seed)
    start = rng.standard_normal(d)
    basis = Basis((start / np.linalg.norm(start))[:, None], np.zeros((0, 0)))
    #: X'U, from which the product with a left vector that is corrected later is corrected, too.
    back, tail = np.zeros((d, 0)), []
    largest = 0.0
    while True:
        k = len(basis.T)
        column, first = np.r_[np.zeros(max(k - 1, 0)), tail[-1:]], True
        while True:
            now, done = basis, column.copy()

            def part(block: np.ndarray) -> list[np.ndarray]:
                x = block - mean
                u, w = now.left(x)
                w = w - u @ done
                return [np.array(w @ w), u.T @ w, x.T @ w]

            square, h, z = summed(rows, part, added)
            square, z, column = float(square) - float(h @ h), z - back @ h, column + h
            #: The neighbour was taken away beforehand; once is enough if what else was found is a trace of what stays.
            if not first or h @ h <= 1e-12 * max(square, 0.0):
                break
            first = False
        alpha = np.sqrt(max(square, 0.0))
        largest = max(largest, alpha, np.linalg.norm(column))
        if alpha <= precise * 8 * max(largest, 1e-300) * np.sqrt(d):
            #: X v lies in the span of the left vectors: no new direction.
            T = np.hstack([basis.T, column[:, None]])
            return basis.V, T, np.array([*tail, 0.0])
        T = np.zeros((k + 1, k + 1))
        T[:k, :k], T[:k, k], T[k, k] = basis.T, column, alpha
        z = z / alpha
        back = np.hstack([back, z[:, None]])
        rest = z.copy()
        for _ in range(2):
            rest -= basis.V @ (basis.V.T @ rest)
        beta = np.linalg.norm(rest)
        tail.append(beta)
        if k + 1 == d or settled(T, beta, wanted, precise):
            return basis.V, T, np.array(tail)
        if beta <= precise * 8 * largest * np.sqrt(d):
            #: An invariant space: go on from a direction that is orthogonal to all before.
            rest = rng.standard_normal(d)
            for _ in range(2):
                rest -= basis.V @ (basis.V.T @ rest)
        basis = Basis(np.hstack([basis.V, (rest / np.linalg.norm(rest))[:, None]]), T)


def settled(T: np.ndarray, beta: float, wanted: int, precise: float) -> bool:
    """Whether the leading singular triplets move by no more than rounding: residual against the gap to the next singular value."""
    k = len(T)
    if k <= wanted or k % 4:
        return False
    left, s, _ = np.linalg.svd(T)
    residual = beta * np.abs(left[-1, :wanted])
    gaps = np.minimum(np.abs(np.diff(s[: wanted + 1])), np.r_[np.inf, np.abs(np.diff(s[:wanted]))])
    return bool(np.all(residual <= precise * np.maximum(gaps, 1e-3 * precise * s[0])))


@dataclass(frozen=True)
class Whitener:
    """``mean`` [d], unit ``components`` [d, c] by falling eigenvalue and their ``values`` [c] over n rows; ``trace`` of the covariance."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = 8) -> Whitener | None:
    """Components of the covariance of rows (vec_id, x), divisor n: at most ``components``, those with variance alone; None without rows."""
    first = summed(rows, lambda x: [np.array(len(x)), x.sum(axis=0)], added)
    if first is None:
        return None
    n, sums = int(first[0]), first[1]
    mean = sums / n
    (trace,) = summed(rows, lambda x: [np.array(((x - mean) ** 2).sum() / n)], added)
    none = Whitener(n, sums, mean, np.zeros((len(mean), 0)), np.zeros(0), float(trace))
    if not trace > 0:
        return none
    V, T, _ = bidiagonalised(rows, mean, wanted=components)
    _, s, right = np.linalg.svd(T)
    keep = s[:components] > 1e-12 * s[0]
    vectors = (V @ right.T[:, : len(s)])[:, :components][:, keep[: len(s)]]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitener(n, sums, mean, vectors, s[:components][keep] ** 2 / n, float(trace))


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """The largest entry, by magnitude, of the covariance of the whitened rows minus the identity."""

    def part(x: np.ndarray) -> list[np.ndarray]:
        w = model.whitened(x)
        own = w - w.mean(axis=0)
        return [np.array(len(w)), w.mean(axis=0), own.T @ own]

    def merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        n, step = a[0] + b[0], b[1] - a[1]
        return [n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (float(a[0]) * float(b[0]) / float(n))]

    n, _, square = summed(rows, part, merge)
    return float(np.abs(square / float(n) - np.eye(len(model.values))).max(initial=0.0))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2 for each row, exact: beyond 63 bits an error, never a wrong number."""
    bound = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if bound * bound * x.shape[1] < 1 << 62:
        return ((n * x - sums) ** 2).sum(axis=1)
    large = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums, strict=True)) for row in x.tolist()]
    if max(large, default=0) >= 1 << 63:
        raise OverflowError("a deviation needs more than 63 bits")
    return np.array(large, np.int64)


def report(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """Per remaining row of embeddings (vec_id, embedding) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    See ``fixed_point`` for the rows that don't remain. Components without variance have no rows, so one row, equal rows and an
    empty table give none; fewer dimensions than components give fewer components. Null and repeated vec_ids are rows like others; signs make a component's
    largest entry positive; other columns are ignored.
    """
    rows = fixed_point(embeddings)
    model = fit(rows, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [c.split()[0] for c in schema.split(", ")]
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, share = identity_error(rows, model), model.values / model.trace
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                x, m = matrix(own), own.num_rows
                ids = own.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
                cells = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(np.repeat(deviations(x, model.n, model.sums), k))]
                cells += [pa.array(v) for v in (model.whitened(x).ravel(), np.tile(share, m), np.full(m * k, error))]
                yield pa.record_batch(cells, names)

    return rows.mapInArrow(tidy(run), schema)
