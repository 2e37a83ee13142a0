"""One linear system from partial ones: a model for each population's variables, brought to one basis along the tree of overlaps.

Populations that share variables see the same states in other coordinates. Each population's model is identified from its own lag
covariances, all of them in parallel. Along an edge of the tree the shared variables' observability gives the change of basis
from child to parent; changes are composed up to the root by joining the tree's table with itself, which doubles the steps each
turn. Loadings in the root's basis predict the covariances of variables that were never seen together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.jobs import fitting, stitching
from tessera.sources.store import stored

PART = "pop_id int, vars array<int>, a array<double>, c array<double>, pi array<double>, r array<double>"


def parts(lagcov: DataFrame, subpop: DataFrame, n: int, k: int) -> DataFrame:
    """(pop_id, vars, a, c, pi, r), matrices flat: the system with n states of each population of subpop (pop_id, var), by subspaces.

    lagcov: (m, i, j, q) for m < 2k over pairs that were seen together. A population's p x p blocks lie in one task; one
    that lacks a pair's lag counts it as zero.
    """
    left, right = (subpop.select("pop_id", F.col("var").alias(c)) for c in "ij")
    rows = lagcov.where(F.col("m") < 2 * k).join(left, "i").join(right, ["pop_id", "j"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(frame["i"])
        q = np.zeros((2 * k, len(names), len(names)))
        q[frame["m"], np.searchsorted(names, frame["i"]), np.searchsorted(names, frame["j"])] = frame["q"]
        a, c, pi, r = fitting.subspace(q, n, k)
        return pd.DataFrame([(int(frame["pop_id"].iloc[0]), names, a.ravel(), c.ravel(), pi.ravel(), r)], columns=[x.split()[0] for x in PART.split(", ")])

    return rows.groupBy("pop_id").applyInPandas(run, PART)


def steps_to_parent(made: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """(pop_id, parent, t): for each edge of tree (pop_id, parent) the flat matrix t with x_pop = t x_parent."""
    up = made.select(F.col("pop_id").alias("parent"), F.col("vars").alias("pvars"), F.col("a").alias("pa"), F.col("c").alias("pc"))
    rows = tree.where("parent IS NOT NULL").select("pop_id", "parent").join(made.select("pop_id", "vars", "a", "c"), "pop_id").join(up, "parent")

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                _, own, theirs = np.intersect1d(r.vars, r.pvars, return_indices=True)
                c, pc = np.reshape(r.c, (-1, n))[own], np.reshape(r.pc, (-1, n))[theirs]
                out.append((r.pop_id, r.parent, stitching.align(c, np.reshape(r.a, (n, n)), pc, np.reshape(r.pa, (n, n)), 2 * n).ravel()))
            yield pd.DataFrame(out, columns=["pop_id", "parent", "t"])

    return rows.mapInPandas(run, "pop_id int, parent int, t array<double>")


def _times(a: str, b: str, n: int):
    """The product of two flat n x n matrices as a column."""
    at = lambda i, j: sum((F.get(a, F.lit(i * n + k)) * F.get(b, F.lit(k * n + j)) for k in range(n)), F.lit(0.0))
    return F.array(*[at(i, j) for i in range(n) for j in range(n)])


def steps_to_root(steps: DataFrame, n: int) -> DataFrame:
    """(pop_id, root, t) from (pop_id, parent, t): matrices composed up the tree, twice as far in each turn."""
    now = stored(steps.select("pop_id", F.col("parent").alias("root"), "t"))
    while True:
        up = now.select(F.col("pop_id").alias("root"), F.col("root").alias("next"), F.col("t").alias("s"))
        both = now.join(up, "root", "left")
        moved = stored(both.select("pop_id", F.coalesce("next", "root").alias("root"), F.when(F.col("s").isNull(), F.col("t")).otherwise(_times("t", "s", n)).alias("t"), F.col("s").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def stitched(lagcov: DataFrame, subpop: DataFrame, tree: DataFrame, n: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Loadings (var, k, w) of all variables in the basis of the tree's root, inner covariances A^m Pi (m, k, l, w) for m < 2k, and noise (var, r).

    These are what ``lagcov.model_cov`` takes. A variable of several populations gets the mean of what they say. Populations that the
    tree does not reach have no rows.
    """
    made = stored(parts(lagcov, subpop, n, k))
    found = steps_to_root(steps_to_parent(made, tree, n), n)
    root = tree.where("parent IS NULL").select("pop_id")
    eye = F.array(*[F.lit(float(i == j)) for i in range(n) for j in range(n)])
    bases = found.select("pop_id", "t").unionByName(root.select("pop_id", eye.alias("t")))
    rows = made.join(bases, "pop_id").select("pop_id", "t", "c", "r", F.posexplode("vars").alias("at", "var"))
    load = lambda i: sum((F.get("c", F.col("at") * n + j) * F.get("t", F.lit(j * n + i)) for j in range(n)), F.lit(0.0))
    cells = rows.select("var", F.get("r", F.col("at")).alias("r"), F.array(*[load(i) for i in range(n)]).alias("w"))
    loadings = cells.select("var", F.posexplode("w").alias("k", "w")).groupBy("var", "k").agg(F.avg("w").alias("w"))
    noise = cells.groupBy("var").agg(F.avg("r").alias("r"))

    def powers(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                a, x = np.reshape(r.a, (n, n)), np.reshape(r.pi, (n, n))
                for m in range(2 * k):
                    out += [(m, i, j, float(x[i, j])) for i in range(n) for j in range(n)]
                    x = a @ x
            yield pd.DataFrame(out, columns=["m", "k", "l", "w"])

    inner = made.join(root, "pop_id").select("a", "pi").mapInPandas(powers, "m int, k int, l int, w double")
    return loadings, inner, noise
