"""As-of joins and piecewise lookups by one sorted pass over both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """left with ``out``: the value of the last right row of the same keys with a time at or before left's.

    Both sides are stacked and the last right value is carried forward, so a key costs one sort of its rows and no
    pair is formed. Right rows come first at equal times; of right rows at one time the largest value counts.
    """
    rows = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    marks = right.groupBy(*keys, at).agg(F.max(value).alias("_value")).withColumn("_side", F.lit(0))
    order = W.partitionBy(*keys).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = rows.unionByName(marks, allowMissingColumns=True)
    carried = both.withColumn(out, F.last("_value", ignorenulls=True).over(order))
    return carried.where("_side = 1").select(*left.columns, out)


def segment_bounds(ends: DataFrame) -> DataFrame:
    """(seg, t_start, t_end, step) from (seg, t_end): each segment begins where the one before ends. One row a segment."""
    start = F.lag("t_end", 1, 0).over(W.orderBy("seg"))
    return ends.select("seg", start.alias("t_start"), "t_end", (F.col("t_end") - start).alias("step"))
