"""Samples and orders that depend on a hash of the keys and a seed: the same in every run and on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(*keys: Column, seed: int) -> Column:
    """A hexadecimal number that orders rows at random."""
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(seed))))


def mini_batch(panel: DataFrame, k: int, seed: int) -> DataFrame:
    """The rows of k trials."""
    trials = panel.select("trial").distinct().orderBy(draw(F.col("trial"), seed=seed)).limit(k)
    return panel.join(trials, "trial", "left_semi")


def sample_vars(panel: DataFrame, k: int, seed: int) -> DataFrame:
    """(var): k variables without replacement."""
    return panel.select("var").distinct().orderBy(draw(F.col("var"), seed=seed)).limit(k)


def random_order(panel: DataFrame, seed: int) -> DataFrame:
    """(trial, t, pos): each trial's steps in a random order."""
    steps = panel.select("trial", "t").distinct()
    order = W.partitionBy("trial").orderBy(draw(F.col("trial"), F.col("t"), seed=seed))
    return steps.select("trial", "t", (F.row_number().over(order) - 1).alias("pos"))
