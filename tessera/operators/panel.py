"""Binning, slicing, masking, windows and set operations over long panels (trial, t, var, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.asof import as_of
from tessera.sources.store import stored


def series():
    return W.partitionBy("trial", "var").orderBy("t")


def bin_spike_times(spikes: DataFrame, dt: float, n_bins: int | None = None) -> DataFrame:
    """Counts per trial, variable and bin, zeros included; times outside the bins don't count.

    Without n_bins a trial has as many bins as fit between 0 and its last spike's time, rounded up. Bins are counted before
    the grid is built, so the join sees one row a filled bin.
    """
    counts = spikes.select("trial", "var", "ts", F.floor(F.col("ts") / dt).cast("int").alias("t"))
    last = F.lit(n_bins) if n_bins is not None else F.floor(F.ceil(F.max("ts")) / dt).cast("int")
    trials = counts.groupBy("trial").agg(last.alias("bins")).where("bins > 0")
    counts = counts.groupBy("trial", "var", "t").agg(F.count("*").alias("y"))
    filled = counts.groupBy("trial", "var").agg(F.map_from_entries(F.collect_list(F.struct("t", "y"))).alias("m"))  # one entry a filled bin
    variables = counts.agg(F.collect_set("var").alias("vars"))  # one row, as long as there are variables
    pairs = trials.join(F.broadcast(variables), how="cross").select("trial", "bins", F.explode("vars").alias("var"))
    rows = pairs.join(filled, ["trial", "var"], "left").select("trial", "var", "m", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("t"))
    return rows.select("trial", "var", "t", F.coalesce(F.element_at("m", F.col("t")), F.lit(0)).cast("long").alias("y"))


def rebin(panel: DataFrame, dt: int, length: int) -> DataFrame:
    """Sums groups of dt bins; an incomplete group at the end is dropped."""
    rows = panel.where(F.col("t") < length // dt * dt)
    return rows.groupBy("trial", "var", F.floor(F.col("t") / dt).cast("int").alias("t")).agg(F.sum("y").alias("y"))


def subsample(panel: DataFrame, dt: int, length: int) -> DataFrame:
    """Every dt-th bin of the complete groups."""
    return panel.where((F.col("t") % dt == 0) & (F.col("t") < length // dt * dt)).withColumn("t", (F.col("t") / dt).cast("int"))


def traces(panel: DataFrame, **keys: list | None) -> DataFrame:
    """Rows whose key columns hold the given values; keys that are None don't filter."""
    for column, values in keys.items():
        if values is not None:
            panel = panel.where(F.col(column).isin(values))
    return panel


def catalog(panel: DataFrame) -> DataFrame:
    return panel.groupBy("experiment").agg(F.countDistinct("t").alias("n_t"), (F.max("t") + 1).cast("long").alias("length"), F.countDistinct("var").alias("n_var"), F.count("*").alias("n_cells"))


def active(steps: DataFrame, schedule: DataFrame) -> DataFrame:
    """steps (t) with the pop_id of the segment t_start <= t < t_end that holds each; null outside all segments.

    Time is cut into about four blocks a segment, so that a segment of any length goes to few blocks; within a block the
    last segment to begin is carried forward. Where segments overlap that one counts.
    """
    span = schedule.where("t_end > t_start").agg(F.count("*").alias("n"), F.min("t_start").alias("a"), F.max("t_end").alias("b")).first()
    width = max(1, -(-(span["b"] - span["a"]) // (4 * span["n"]))) if span["n"] else 1
    block = lambda c: F.floor(F.col(c) / width)
    marks = schedule.where("t_end > t_start").withColumn("last", F.col("t_end") - 1)
    marks = marks.select(F.explode(F.sequence(block("t_start"), block("last"))).alias("block"), "t_start", F.struct("t_start", "t_end", "pop_id").alias("seg"))
    marks = marks.select("block", F.greatest(F.col("t_start").cast("long"), F.col("block") * width).alias("t"), "seg")
    found = as_of(steps.select(F.col("t").cast("long").alias("t"), block("t").alias("block")), marks, ["block"], "t", "seg", "seg")
    return found.select("t", F.when(F.col("t") < F.col("seg.t_end"), F.col("seg.pop_id")).alias("pop_id"))


def apply_scheme(panel: DataFrame, subpop: DataFrame, schedule: DataFrame, max_steps: int = 100_000) -> DataFrame:
    """y is null where the population active at t doesn't hold var; rows outside all segments go.

    Each step that the panel has is looked up once; steps join on time, membership on (pop, var), both by equality. Up to
    max_steps steps are broadcast.
    """
    steps = stored(active(panel.select("t").distinct(), schedule).where("pop_id IS NOT NULL"))
    small = steps.limit(max_steps + 1).count() <= max_steps
    rows = panel.join(F.broadcast(steps) if small else steps, "t").join(subpop.withColumn("seen", F.lit(True)), ["pop_id", "var"], "left")
    return rows.select(*[c for c in panel.columns if c != "y"], F.when(F.col("seen"), F.col("y")).alias("y"))


def center(panel: DataFrame) -> DataFrame:
    return panel.withColumn("y", F.col("y") - F.avg("y").over(W.partitionBy("trial", "var")))


def lag_lead(panel: DataFrame) -> DataFrame:
    return panel.select("trial", "var", "t", "y", F.lag("y").over(series()).alias("y_prev"), F.lead("y").over(series()).alias("y_next"))


def windows(panel: DataFrame, k: int) -> DataFrame:
    """The full k-step windows of each series, as arrays."""
    w = series().rowsBetween(0, k - 1)
    rows = panel.select("trial", "var", "t", F.collect_list("y").over(w).alias("w"))
    return rows.where(F.size("w") == k)


def history(panel: DataFrame, q: int) -> DataFrame:
    """The q bins before each bin as features; rows without all of them are dropped."""
    rows = panel.select("trial", "var", "t", "y", *[F.lag("y", k).over(series()).alias(f"h{k}") for k in range(1, q + 1)])
    return rows.where(F.col(f"h{q}").isNotNull())


def io_windows(outputs: DataFrame, inputs: DataFrame, k: int, l: int) -> DataFrame:  # noqa: E741
    """(trial, row, side, lag, var, y): rows of k steps of inputs (side u) and outputs (y), row n from step l + n on.

    A trial has its number of steps - k - l + 1 rows, by its outputs.
    """
    spans = outputs.groupBy("trial").agg((F.max("t") - k - l + 1).alias("last")).where("last >= 0")
    both = inputs.select("trial", "t", "var", F.lit("u").alias("side"), "y").unionByName(outputs.select("trial", "t", "var", F.lit("y").alias("side"), "y"))
    rows = both.join(spans, "trial").select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("lag"))
    rows = rows.withColumn("row", F.col("t") - l - F.col("lag")).where(F.col("row").between(0, F.col("last")))
    return rows.select("trial", "row", "side", "lag", "var", "y")


def concat_trials(panel: DataFrame) -> DataFrame:
    """Trials laid end to end: t becomes the time in all of them. One row a trial goes through the window."""
    lengths = panel.groupBy("trial").agg((F.max("t") + 1).alias("length"))
    before = F.coalesce(F.sum("length").over(W.orderBy("trial").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = lengths.select("trial", before.alias("offset"))
    return panel.join(offsets, "trial").select((F.col("t") + F.col("offset")).cast("long").alias("t"), "var", "y")


def silent(panel: DataFrame) -> DataFrame:
    """Rows of the variables that have any count at all."""
    alive = panel.groupBy("var").agg(F.sum("y").alias("n")).where("n <> 0").select("var")
    return panel.join(alive, "var", "left_semi")


def rates(spikes: DataFrame, hours: float, least: float) -> DataFrame:
    """Variables with at least ``least`` spikes an hour."""
    return spikes.groupBy("var").agg(F.count("*").alias("n")).select("var", "n", (F.col("n") / hours).alias("rate")).where(F.col("rate") >= least)


def psth(panel: DataFrame) -> DataFrame:
    return panel.groupBy("var", "t").agg(F.avg("y").alias("rate"), F.count("*").alias("n_trials"))


def spike_stats(panel: DataFrame) -> DataFrame:
    return panel.groupBy("var").agg(F.max("y").alias("most"), F.avg("y").alias("mean"), F.avg((F.col("y") != 0).cast("double")).alias("share"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
