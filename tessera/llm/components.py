"""Connected components by alternating large-star and small-star steps, all in grouped joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import join_hot, stored


def _to_least(edges: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    return join_hot(stored(edges), least, ["a"], "b") if hubs else edges.join(least, "a")


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every node links its larger neighbours to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _to_least(both, least, hubs).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _to_least(edges, least, hubs).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a stored table, with their number and a checksum, taken as they are written."""
    seen = Observation()
    now = stored(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
    return now, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame, one_task: int = 1_000_000) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots; a root is the least node of its component.

    Each round is written to a shared table; rounds end when the edges no longer change. From one_task edges on the
    edges of hubs are dealt to several tasks. Loops and repeated edges change nothing; a null end is no edge; no
    edges give no rows.
    """
    now, mark = _marked(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while mark != seen and mark[0]:
        seen, hubs = mark, mark[0] > one_task
        now, mark = _marked(_small_star(_large_star(now, hubs), hubs))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
