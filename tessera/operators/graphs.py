"""Dependency tables (parent, child, dt) between variable groups: scopes, conditionals, cycles and sampling order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import stored


def time_scope(dep: DataFrame) -> DataFrame:
    return dep.select("dt").distinct()


def conditionals(dep: DataFrame) -> DataFrame:
    """(child, parents): each child's sorted dt:parent pairs."""
    pairs = F.sort_array(F.collect_set(F.struct("dt", "parent")))
    return dep.groupBy("child").agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["dt"].cast("string"), x["parent"].cast("string"))), ",").alias("parents"))


def flags(dep: DataFrame) -> DataFrame:
    """Whether no parent lies in the future (causal), and the number of edges within one time step."""
    return dep.agg((F.max("dt") <= 0).alias("causal"), F.count_if(F.col("dt") == 0).alias("n_instant"))


def initial(dep: DataFrame) -> DataFrame:
    """Parents at earlier steps: they need a distribution of their own at the start."""
    return dep.where("dt < 0").select("parent").distinct()


def sampling_order(dep: DataFrame) -> DataFrame:
    """(node, generation): the longest chain of instantaneous parents above each node.

    Each round settles the nodes whose parents are all settled, until nothing changes. Nodes on or below a cycle get none.
    """
    edges = stored(dep.where("dt = 0").select("parent", "child").distinct())
    state = stored(dep.select(F.col("parent").alias("node")).union(dep.select("child")).distinct().withColumn("generation", F.lit(None).cast("int")))
    unsettled, generation = state.count(), 0
    while unsettled:
        waiting = edges.join(state.where("generation IS NULL"), F.col("parent") == F.col("node")).select("child").distinct()
        free = F.col("generation").isNull() & F.col("child").isNull()
        state = stored(state.join(waiting, F.col("node") == F.col("child"), "left").select("node", F.when(free, F.lit(generation)).otherwise(F.col("generation")).alias("generation")))
        now = state.where("generation IS NULL").count()
        if now == unsettled:
            break
        unsettled, generation = now, generation + 1
    return state.where("generation IS NOT NULL")


def own_ancestors(dep: DataFrame, most: int = 64) -> DataFrame:
    """(node): groups that are their own ancestor within one time step."""
    edges = stored(dep.where("dt = 0").select("parent", "child").distinct())
    reach, size = edges, edges.count()
    for _ in range(most):
        step = reach.select("parent", F.col("child").alias("mid")).join(reach.select(F.col("parent").alias("mid"), "child"), "mid").select("parent", "child")
        reach = stored(reach.union(step).distinct())
        now = reach.count()
        if now == size:
            break
        size = now
    return reach.where("parent = child").select(F.col("parent").alias("node"))


def check(dependencies: DataFrame) -> DataFrame:
    """(rule, violations): what dependencies (parent, child, dt) may not hold."""
    key = F.struct("parent", "child", "dt")
    unknown = F.col("parent").isNull() | F.col("child").isNull() | F.col("dt").isNull()
    counts = dependencies.agg(
        F.count_if(F.col("dt") > 0).alias("acausal"), F.count_if((F.col("dt") == 0) & (F.col("parent") == F.col("child"))).alias("instant_self"), F.count_if(unknown).alias("unknown")
    )
    again = dependencies.groupBy(key.alias("key")).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    one = counts.join(F.broadcast(again))  # one row each
    names = ["acausal", "instant_self", "repeated", "unknown"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in names])).alias("x")).select("x.*")
