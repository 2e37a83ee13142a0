"""Streams of events: hourly counts under a watermark and a causal filter that keeps its state between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.panels import table
from tessera.sources.store import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream, with ts as a timestamp."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(rows: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns what it wrote below folder."""
    spark, folder = rows.sparkSession, folder or shared_dir(rows.sparkSession)
    query = rows.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def hourly(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """(event_type, h, n): counts of the hours that the watermark has closed; later events are dropped."""
    hours = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return hours.select("event_type", F.floor(F.unix_micros(F.col("window.start")) / 3_600_000_000).alias("h"), "n")


def closed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(hourly(event_stream(spark, sf_dir)))


def filtered_counts(spark: SparkSession, sf_dir: str, *, a: float, q: float, c: float, d: float, r: float, mu0: float, v0: float) -> DataFrame:
    """(event_type, h, mu, v): a one-dimensional filter over each type's closed hours; missing hours are predicted through.

    The state of a type is the last hour and its mean and variance, whatever the stream's length.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("h")
        last, mu, v = state.get if state.exists else (None, mu0, v0)
        out = []
        for h, n in zip(rows["h"], rows["n"], strict=True):
            if last is not None:
                for _ in range(int(h - last)):
                    mu, v = a * mu, a * a * v + q
            gain = 1 / (c * c / r + 1 / v)
            mu, v, last = mu + gain * c * (n - d - c * mu) / r, gain, int(h)
            out.append((key[0], last, mu, v))
        state.update((last, mu, v))
        yield pd.DataFrame(out, columns=["event_type", "h", "mu", "v"])

    folder = shared_dir(spark)
    written = _finished(hourly(event_stream(spark, sf_dir)), folder)
    counts = spark.readStream.schema(written.schema).parquet(f"{folder}/out")
    found = counts.groupBy("event_type").applyInPandasWithState(step, "event_type string, h long, mu double, v double", "last long, mu double, v double", "append", GroupStateTimeout.NoTimeout)
    return _finished(found)

