"""Normal equations and linear maps over panels, summed by Spark and solved where they are small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def step_sums(panel: DataFrame) -> DataFrame:
    """(var, s00, s01, s11, n): sums of y(t)^2, y(t) y(t+1) and y(t+1)^2 over neighbouring steps of a trial."""
    nxt = F.lead("y").over(W.partitionBy("trial", "var").orderBy("t"))
    rows = panel.select("var", F.col("y").cast("double").alias("y"), nxt.cast("double").alias("z")).where("z IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("var").agg(F.sum(F.col("y") ** 2).alias("s00"), F.sum(F.col("y") * F.col("z")).alias("s01"), F.sum(F.col("z") ** 2).alias("s11"), F.count("*").alias("n"))


def observed_dynamics(panel: DataFrame) -> DataFrame:
    """(var, a, q): first-order dynamics of each observed series and the variance that they leave."""
    a = F.col("s01") / F.col("s00")
    return step_sums(panel).where("s00 > 0").select("var", a.alias("a"), ((F.col("s11") - a * F.col("s01")) / F.col("n")).alias("q"))


def affine(panel: DataFrame, weights: DataFrame, offsets: DataFrame) -> DataFrame:
    """(trial, t, out, y): sums of weight (out, var, w) times y, plus offset (out, b), at every step."""
    rows = panel.join(weights, "var").groupBy("trial", "t", "out").agg(F.sum(F.col("w") * F.col("y")).alias("y"))
    return rows.join(offsets, "out").select("trial", "t", "out", (F.col("y") + F.col("b")).alias("y"))
