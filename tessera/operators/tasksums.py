"""Sums of named arrays: each task adds up its own, then tasks are added up; what comes back has the size of a model's parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Arrays = dict[str, np.ndarray]
SCHEMA = "sums array<struct<name: string, shape: array<int>, data: array<double>>>"
_TYPE = pa.list_(pa.struct([("name", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float64()))]))


def added(parts: Iterable[Arrays]) -> Arrays:
    """Sums by name; a name that only some parts have counts as zero in the others."""
    out: Arrays = {}
    for part in parts:
        for name, a in part.items():
            out[name] = out[name] + a if name in out else a
    return out


def _packed(sums: Arrays) -> Iterator[pa.RecordBatch]:
    if sums:
        cells = [{"name": k, "shape": list(a.shape), "data": np.asarray(a, float).ravel()} for k, a in sums.items()]
        yield pa.record_batch([pa.array([cells], _TYPE)], ["sums"])


def _arrays(row: list[dict]) -> Arrays:
    return {c["name"]: np.array(c["data"], float).reshape(c["shape"]) for c in row}


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], Iterable[Arrays]], *, fan_in: int = 64) -> Arrays:
    """The sum of the arrays that ``part`` makes of each batch of rows; empty without rows.

    A task sends one row. More than fan_in tasks are added up by a second round of tasks, of which each takes about fan_in rows.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(added(a for batch in batches for a in part(batch)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(added(_arrays(row) for batch in batches for row in batch.column("sums").to_pylist()))

    sent = rows.mapInArrow(one, SCHEMA)
    tasks = rows.rdd.getNumPartitions()
    if tasks > fan_in:
        sent = sent.repartition(-(-tasks // fan_in)).mapInArrow(again, SCHEMA)
    return added(_arrays([c.asDict() for c in r["sums"]]) for r in sent.collect())
