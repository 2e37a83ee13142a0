"""Principal components of counts: y ~ Poisson(exp(C x + d)), by turns over loadings and factors.

With the factors of all steps fixed, each variable's loadings are a Poisson regression of its own; with the loadings fixed, each step's factors
are one. Both are solved for all keys at once by ``learning.poisson_regression`` from where the turn before ended, so the
penalised loss falls in every turn. Cells stay long rows joined by variable or by (trial, t); no matrix is put together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import learning
from tessera.sources.store import stored


def factored(panel: DataFrame, n: int, *, turns: int = 5, penalty: float = 0.1, newton: int = 4, seed: int = 0) -> tuple[DataFrame, DataFrame, list[float]]:
    """Loadings (var, b array: n weights and the offset), factors (trial, t, x array) and the loss by turn, for a panel (trial, t, var, y).

    The loss is that of the counts without the factorials plus penalty / 2 times the squares of loadings and factors; offsets are free. Null
    cells aren't seen. Factors begin at small normal numbers from a hash of (trial, t), offsets at the logarithm of a variable's mean. A turn takes at most
    ``newton`` safeguarded steps a side. An empty panel gives no rows and no loss. One row a variable and one a step are stored a turn.
    """
    cells = stored(panel.where("y IS NOT NULL").select(F.col("trial").cast("long").alias("trial"), F.col("t").cast("long").alias("t"), F.col("var").cast("int").alias("var"), F.col("y").cast("double").alias("y")))
    spans = cells.agg(F.min("t"), F.max("t")).first()
    if spans[0] is None:
        return cells.select("var", F.array(F.lit(0.0)).alias("b")), cells.select("trial", "t", F.array(F.lit(0.0)).alias("x")), []
    width = spans[1] - spans[0] + 1
    #: One number for (trial, t).
    cells = cells.withColumn("step", F.col("trial") * width + F.col("t") - spans[0])
    uniform = lambda k, s: (F.pmod(F.xxhash64("step", F.lit(seed), F.lit(k), F.lit(s)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda k: F.sqrt(-2 * F.log(uniform(k, 0))) * F.cos(2 * np.pi * uniform(k, 1))
    factors = stored(cells.select("step").distinct().select("step", F.array(*[0.3 * normal(k) for k in range(n)]).alias("x")))
    level = F.log(F.greatest(F.avg("y"), F.lit(0.01)))
    loadings = stored(cells.groupBy("var").agg(F.concat(F.array_repeat(F.lit(0.0), n), F.array(level)).alias("b")))
    own = penalty * np.diag([*np.ones(n), 0.0])
    losses: list[float] = []
    for _ in range(turns):
        rows = cells.join(factors, "step").select("var", "y", F.concat("x", F.array(F.lit(1.0))).alias("z"), F.lit(0.0).alias("offset"))
        made = stored(learning.poisson_regression(rows, n + 1, penalty=own, rounds=newton, start=loadings))
        loadings = made.select("var", "b")
        rows = cells.join(loadings, "var").select(F.col("step").alias("var"), "y", F.slice("b", 1, n).alias("z"), F.get("b", F.lit(n)).alias("offset"))
        made = stored(learning.poisson_regression(rows, n, penalty=penalty, rounds=newton, start=factors.select(F.col("step").alias("var"), F.col("x").alias("b"))))
        factors = made.select(F.col("var").alias("step"), F.col("b").alias("x"))
        squares = F.aggregate(F.slice("b", 1, n), F.lit(0.0), lambda s, w: s + w * w)
        fixed = loadings.agg(F.sum(squares)).first()[0]
        losses.append(made.agg(F.sum("loss")).first()[0] + penalty / 2 * fixed)
    place = F.col("step")
    steps = factors.select(F.floor(place / width).alias("trial"), (F.pmod(place, F.lit(width)) + spans[0]).alias("t"), "x")
    return loadings, steps, losses
