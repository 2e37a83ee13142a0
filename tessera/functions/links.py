"""Expectations of link functions under a normal distribution, as a table and as a lookup in columns; link functions for inference."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Means from ``low`` on, ``n_means`` of them ``step`` apart, and deviations from 0 on, ``n_devs`` of them ``dev_step`` apart."""

    low: float = -6.0
    step: float = 0.25
    n_means: int = 49
    dev_step: float = 0.25
    n_devs: int = 13

    @property
    def size(self) -> int:
        return self.n_means * self.n_devs


def softplus(x: Column) -> Column:
    """log(1 + exp(x)), also for large x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def table(spark: SparkSession, link: Callable[[Column], Column], grid: Grid = Grid(), *, reach: float = 8.0, nodes: int = 321) -> DataFrame:
    """(i, k, m, s, value): the mean of link(m + s z) over a standard normal z, by the trapezoid rule on ``nodes`` nodes from -reach to reach."""
    width = 2 * reach / (nodes - 1)
    rows = spark.range(grid.size).select((F.col("id") / grid.n_devs).cast("int").alias("i"), (F.col("id") % grid.n_devs).cast("int").alias("k"))
    rows = rows.select("i", "k", (F.lit(grid.low) + F.col("i") * grid.step).alias("m"), (F.col("k") * grid.dev_step).alias("s"))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("z")).withColumn("z", F.col("z") * width - reach)
    weight = F.exp(-F.col("z") ** 2 / 2)
    return each.groupBy("i", "k", "m", "s").agg((F.sum(weight * link(F.col("m") + F.col("s") * F.col("z"))) / F.sum(weight)).alias("value"))


def expected(rows: DataFrame, values: DataFrame, m: str, s: str, out: str, grid: Grid = Grid()) -> DataFrame:
    """rows with ``out``: the expectation at mean ``m`` and deviation ``s``, between four entries of a table; outside of it the nearest edge counts.

    The table's values are one array, as long as the grid, which goes to every row by a broadcast of one row; a null m or s gives null.
    """
    packed = values.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "k", "value"))), lambda c: c["value"]).alias("_values"))
    place = lambda c, low, step, n: F.least(F.greatest((F.col(c) - low) / step, F.lit(0.0)), F.lit(float(n - 1)))
    both = rows.join(F.broadcast(packed), how="cross")  # one row
    both = both.withColumns({"_x": place(m, grid.low, grid.step, grid.n_means), "_y": place(s, 0.0, grid.dev_step, grid.n_devs)})
    both = both.withColumns({"_i": F.least(F.floor("_x"), F.lit(grid.n_means - 2)).cast("int"), "_k": F.least(F.floor("_y"), F.lit(grid.n_devs - 2)).cast("int")})
    at = lambda a, b: F.get("_values", (F.col("_i") + a) * grid.n_devs + F.col("_k") + b)
    x, y = F.col("_x") - F.col("_i"), F.col("_y") - F.col("_k")
    value = (1 - x) * ((1 - y) * at(0, 0) + y * at(0, 1)) + x * ((1 - y) * at(1, 0) + y * at(1, 1))
    known = F.col(m).isNotNull() & F.col(s).isNotNull()
    return both.withColumn(out, F.when(known, value)).drop("_values", "_x", "_y", "_i", "_k")


@dataclass(frozen=True)
class Link:
    """The rate of counts at drive h, and its first and second derivative."""

    rate: Callable[[np.ndarray], np.ndarray]
    first: Callable[[np.ndarray], np.ndarray]
    second: Callable[[np.ndarray], np.ndarray]

    def terms(self, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood of counts y without the factorials, its derivative by h, and the negative of the second one, at least 0."""
        f, a, b = self.rate(h), self.first(h), self.second(h)
        return y * np.log(f) - f, (y / f - 1) * a, np.maximum(y * (a / f) ** 2 - (y / f - 1) * b, 0.0)


def _capped(h: np.ndarray) -> np.ndarray:
    return np.exp(np.minimum(h, 50.0))


def _sigmoid(h: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(h / 2))


def _soft(h: np.ndarray) -> np.ndarray:
    return np.maximum(np.logaddexp(0.0, h), 1e-300)


#: Both links have concave log-likelihoods, so a path has one mode.
LINKS = {
    "exp": Link(_capped, _capped, _capped),
    "softplus": Link(_soft, _sigmoid, lambda h: _sigmoid(h) * (1 - _sigmoid(h))),
}
