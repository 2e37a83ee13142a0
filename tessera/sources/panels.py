"""Panels (trial, t, var, y) made from the given tables, and observation schemes over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as spike times: trial (day), var (event type in order), ts in hours since the day began, value."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct()
    kinds = kinds.select("event_type", (F.row_number().over(W.orderBy("event_type")) - 1).alias("var"))  # one row a type
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    rows = events.select("event_type", "value", micros.alias("us")).join(kinds, "event_type")
    day = 24 * 3600 * 1_000_000
    return rows.select(F.floor(F.col("us") / day).cast("int").alias("trial"), "var", ((F.col("us") % day) / 3.6e9).alias("ts"), "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a dense panel: experiment (label), t (vec_id), var (position), y."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("experiment"), F.col("vec_id").cast("int").alias("t"), F.posexplode("embedding").alias("var", "y"))
    return rows.select("experiment", "t", "var", F.col("y").cast("double").alias("y"))


def subpops(panel: DataFrame, size: int = 16, overlap: int = 4) -> DataFrame:
    """(pop_id, var): blocks of ``size`` variables, each widened by ``overlap`` on both sides."""
    variables = panel.select("var").distinct()
    last = F.floor(F.max("var").over(W.partitionBy(F.lit(1))) / size)
    near = F.sequence(F.floor((F.col("var") - overlap) / size), F.floor((F.col("var") + overlap) / size))
    rows = variables.select("var", last.alias("last"), F.explode(near).alias("pop_id"))
    return rows.where("pop_id BETWEEN 0 AND last").select(F.col("pop_id").cast("int").alias("pop_id"), "var")


def schedule(panel: DataFrame, segments: int = 4) -> DataFrame:
    """(seg, t_start, t_end, pop_id): equal stretches of time, population seg active in stretch seg."""
    last = panel.agg((F.max("t") + 1).alias("length"))
    rows = last.select("length", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("seg"))
    edge = lambda s: F.floor(s * F.col("length") / segments).cast("int")
    return rows.select("seg", edge(F.col("seg")).alias("t_start"), edge(F.col("seg") + 1).alias("t_end"), F.col("seg").alias("pop_id"))
