"""Observation schemes: checks, index groups, overlaps, pair masks and traversal."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.store import stored


def check(panel: DataFrame, subpop: DataFrame, schedule: DataFrame) -> DataFrame:
    """(rule, violations): what a valid scheme has none of."""
    order = W.orderBy("seg")
    gaps = schedule.withColumn("before", F.lag("t_end", 1, 0).over(order))
    length = panel.agg((F.max("t") + 1).alias("length"))
    rules = {
        "uncovered_variable": panel.select("var").distinct().join(subpop, "var", "left_anti"),
        "gap_in_time": gaps.where("t_start <> before"),
        "empty_segment": schedule.where("t_end <= t_start"),
        "unknown_population": schedule.join(subpop, "pop_id", "left_anti"),
        "wrong_end": schedule.agg(F.max("t_end").alias("e")).join(length, F.col("e") != F.col("length")),
    }
    out = None
    for name, rows in rules.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def index_groups(subpop: DataFrame) -> DataFrame:
    """(var, pattern, grp): variables with the same memberships share a group.

    The pattern is the sorted list of populations, so their number isn't bounded by a word's bits. Groups are numbered by their
    least variable; the window sees one row a group.
    """
    members = subpop.groupBy("var").agg(F.array_join(F.transform(F.sort_array(F.collect_set("pop_id")), lambda p: p.cast("string")), "-").alias("pattern"))
    names = members.groupBy("pattern").agg(F.min("var").alias("first"))
    names = names.select("pattern", (F.row_number().over(W.orderBy("first")) - 1).alias("grp"))
    return members.join(names, "pattern").select("var", "pattern", "grp")


def visible_groups(subpop: DataFrame, schedule: DataFrame) -> DataFrame:
    """(seg, grp): groups seen in each segment."""
    return schedule.join(subpop, "pop_id").join(index_groups(subpop), "var").select("seg", "grp").distinct()


def co_observed(subpop: DataFrame, schedule: DataFrame) -> DataFrame:
    """(grp_a, grp_b): pairs of groups seen together in some segment."""
    v = visible_groups(subpop, schedule)
    return v.select("seg", F.col("grp").alias("grp_a")).join(v.select("seg", F.col("grp").alias("grp_b")), "seg").select("grp_a", "grp_b").distinct()


def index_overlaps(subpop: DataFrame) -> DataFrame:
    """(grp, n_pops, pops) of the groups in more than one population."""
    rows = subpop.join(index_groups(subpop), "var").groupBy("grp").agg(F.countDistinct("pop_id").alias("n_pops"), F.array_join(F.transform(F.sort_array(F.collect_set("pop_id")), lambda p: p.cast("string")), ",").alias("pops"))
    return rows.where("n_pops > 1")


def observed_pairs(subpop: DataFrame) -> DataFrame:
    """(i, j, n_pops): variable pairs that share a population, with the number that they share."""
    a, b = subpop.select("pop_id", F.col("var").alias("i")), subpop.select("pop_id", F.col("var").alias("j"))
    return a.join(b, "pop_id").groupBy("i", "j").agg(F.count("*").alias("n_pops"))


def double_pairs(subpop: DataFrame) -> DataFrame:
    """(i, j): variable pairs that share more than one population."""
    return observed_pairs(subpop).where("n_pops > 1").select("i", "j")


def cross_pairs(subpop: DataFrame) -> DataFrame:
    """(i, j): pairs of one population and different groups, of which one group at least is in several populations."""
    shared = index_overlaps(subpop).select("grp", F.lit(True).alias("several"))
    named = index_groups(subpop).join(shared, "grp", "left").select("var", "grp", F.coalesce("several", F.lit(False)).alias("several"))
    rows = observed_pairs(subpop).select("i", "j")
    for c in "ij":
        rows = rows.join(named.select(F.col("var").alias(c), F.col("grp").alias(f"g{c}"), F.col("several").alias(f"s{c}")), c)
    return rows.where("gi <> gj AND (si OR sj)").select("i", "j")


def stitched_pairs(subpop: DataFrame) -> DataFrame:
    """(i, j) with i < j that share no population. The output itself is quadratic in the variables."""
    v = subpop.select("var").distinct()
    pairs = v.select(F.col("var").alias("i")).join(v.select(F.col("var").alias("j")), F.col("i") < F.col("j"))
    return pairs.join(observed_pairs(subpop), ["i", "j"], "left_anti")


def overlaps(subpop: DataFrame) -> DataFrame:
    """(a, b, n_shared) of populations a < b that share variables."""
    x, y = subpop.select("var", F.col("pop_id").alias("a")), subpop.select("var", F.col("pop_id").alias("b"))
    return x.join(y, "var").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def traversal(subpop: DataFrame, root: int = 0) -> DataFrame:
    """(pop_id, depth): distance of every reachable population from the root along overlaps, breadth first."""
    edges = overlaps(subpop)
    edges = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    seen = edges.sparkSession.range(1).select(F.lit(root).alias("pop_id"), F.lit(0).alias("depth"))
    new = seen
    for depth in count(1):
        front = new.join(edges, F.col("pop_id") == F.col("a")).select(F.col("b").alias("pop_id")).distinct()
        new = stored(front.join(seen, "pop_id", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def tree(subpop: DataFrame, root: int = 0) -> DataFrame:
    """(pop_id, parent, place): the populations that overlaps reach from root, depth first; the root's parent is null.

    A node claims all neighbours that are still open, in order, as its children; then each child's subtree is walked, in order. place:
    the order in which they were claimed. The walk is serial and sees one row a population, its neighbours: the scheme, no data.
    """
    left, right = subpop.select(F.col("pop_id").alias("a"), "var"), subpop.select(F.col("pop_id").alias("b"), "var")
    edges = left.join(right, "var").where("a <> b").groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("near"))
    rows = subpop.select(F.col("pop_id").alias("a")).distinct().join(edges, "a", "left").select("a", F.coalesce("near", F.array().cast("array<int>")).alias("near"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        near = dict(zip(frame["a"].tolist(), frame["near"], strict=True))
        if root not in near:
            return pd.DataFrame([], columns=["pop_id", "parent", "place"])
        claimed, stack, out = {root}, [root], [(root, None)]
        while stack:
            node = stack.pop()
            own = [int(x) for x in near[node] if x not in claimed]
            claimed.update(own)
            out += [(x, node) for x in own]
            stack += own[::-1]
        return pd.DataFrame({"pop_id": [x for x, _ in out], "parent": pd.array([p for _, p in out], "Int32"), "place": range(len(out))})

    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(walk, "pop_id int, parent int, place int")


def members(subpop: DataFrame, pop_id: int) -> DataFrame:
    return subpop.where(F.col("pop_id") == pop_id).select("var")


def local_index(subpop: DataFrame) -> DataFrame:
    """Position of each variable inside its populations."""
    return subpop.select("pop_id", "var", (F.row_number().over(W.partitionBy("pop_id").orderBy("var")) - 1).alias("pos"))
