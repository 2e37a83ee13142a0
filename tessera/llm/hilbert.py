"""Sharding along a Hilbert curve over quantised metadata.

Language, source and size are quantised to ``bits`` bits each; the curve index of that cell orders all
documents, and equal runs of the order become shards. Neighbours on the curve are near in every
dimension, so each shard covers narrow ranges of all of them and readers can skip files by any. Equal texts take one cell, that of
the least doc_id among them, and shards end between groups of equal texts where their sizes leave a choice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import bounded, join_hot, stored


def curve_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of the cells with these coordinates, each below 2**bits.

    From the highest bit down, each coordinate is reflected or exchanged with the first as its bit says; a Gray code
    of the result, bits interleaved, is the index.
    """
    x = [np.array(a, np.int64) for a in axes]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for a in x:
            is_set = (a & bit) != 0
            swap = np.where(is_set, 0, (x[0] ^ a) & low)
            x[0] ^= np.where(is_set, low, 0)
            x[0] ^= swap
            if a is not x[0]:
                a ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in x:
            out = (out << 1) | (((a ^ flip) >> level) & 1)
    return out


def by_share(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, cell): distinct values in order, null first, spread over 2**bits cells by the rows before them.

    Values are sorted by range; only one sum a task goes through a single window.
    """
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    counts = counts.repartitionByRange(F.col("value").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    counts = stored(counts)
    parts = counts.groupBy("part").agg(F.sum("n").alias("own"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("first"), F.sum("own").over(W.partitionBy(F.lit(1))).alias("total"))
    within = W.partitionBy("part").orderBy(F.col("value").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("first") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return counts.join(parts, "part").select("value", F.floor(before * (1 << bits) / F.col("total")).cast("long").alias("cell"))


def size_cell(size: Column, bits: int) -> Column:
    """Sixteen cells an octave at 8 bits: rises with the logarithm of the size."""
    return F.least(F.floor(F.log2(size) * (1 << bits) / 32), F.lit((1 << bits) - 1)).cast("long")


def as_groups(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """rows (doc_id, size, text_hash, cell) in which equal texts have one cell, that of the least doc_id.

    Only groups of several rows are looked up: up to ``most`` of them by broadcast, more by a join that deals out the rows of large groups.
    """
    rows = stored(rows)
    several = rows.groupBy("text_hash", "size").agg(F.min(F.struct("doc_id", "cell")).alias("x"), F.count("*").alias("n")).where("n > 1")
    several = stored(several.select("text_hash", "size", F.col("x.cell").alias("shared")))
    keys = ["text_hash", "size"]
    found = rows.join(F.broadcast(several), keys, "left") if bounded(several, most) else join_hot(rows, several, keys, "doc_id", how="left")
    return found.withColumn("cell", F.coalesce("shared", "cell")).drop("shared")


def ends(total: int, n_shards: int, cut: set[int], band: int = 32) -> list[int]:
    """The rank at which each shard ends: sizes differ by one at most, and as few ends as possible lie in ``cut``.

    The shards that take one row more can be any of them. Of all ways those are compared in which, after s shards, their number is within
    ``band`` of an even spread; up to 64 shards that is every way.
    """
    least, more = divmod(total, n_shards)
    best: dict[int, tuple[int, list[int]]] = {0: (0, [])}
    for s in range(1, n_shards + 1):
        now: dict[int, tuple[int, list[int]]] = {}
        for used, (torn, large) in best.items():
            for one in (1, 0):
                j = used + one
                if j > more or more - j > n_shards - s or abs(j - s * more / n_shards) > band:
                    continue
                cost = torn + (s < n_shards and s * least + j in cut)
                if j not in now or cost < now[j][0]:
                    now[j] = (cost, [*large, s - 1] if one else large)
        best = now
    _, large = best[more]
    sizes = np.full(n_shards, least)
    sizes[large] += 1
    return np.cumsum(sizes).tolist()


def candidates(total: int, n_shards: int, band: int = 32) -> list[int]:
    """The ranks at which some shard can end."""
    least, more = divmod(total, n_shards)
    spread = lambda s: range(max(0, more - (n_shards - s), int(s * more / n_shards) - band), min(more, s, int(s * more / n_shards) + band) + 1)
    return sorted({s * least + j for s in range(1, n_shards) for j in spread(s)})


def shard(docs: DataFrame, n_shards: int = 24, *, bits: int = 8) -> DataFrame:
    """Per row of docs (doc_id, text, lang, source): doc_id, size, text_crc32, law, shard, slot, grown_shard, cell.

    The law is ``rows``: shards' counts differ by one at most; slot numbers a shard's rows from 0 in curve order. Equal texts are ordered
    side by side in one cell; a group is cut only where no choice of the larger shards keeps it whole. A null text has size 8 and the checksum of an
    empty one; null lang, source and doc_id are values like others, repeated rows are placed one by one, long texts are read
    whole, other columns are ignored. Empty tables give no rows.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", "lang", "source", (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("text_hash"))
    for column in ("lang", "source"):
        cells = by_share(docs.select(column), column, bits).withColumnRenamed("cell", f"{column}_cell")
        rows = rows.join(cells, F.col(column).eqNullSafe(F.col("value")), "left").drop("value")
    index = F.pandas_udf(lambda a, b, c: pd.Series(curve_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], bits)), "long")
    rows = rows.withColumn("cell", index("lang_cell", "source_cell", size_cell(F.col("size"), bits)))
    order = ["cell", "text_hash", "size", "doc_id"]
    rows = as_groups(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", "text_hash", "cell"))
    rows = rows.select("doc_id", "size", "text_crc32", "text_hash", "cell").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            yield batch.append_column("pos", pa.array(np.arange(n, n + batch.num_rows)))
            n += batch.num_rows

    placed = stored(rows.mapInArrow(number, "doc_id long, size long, text_crc32 long, text_hash long, cell long, part int, pos long"))
    #: One row a task of the sort.
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    placed = placed.join(parts, "part").withColumn("rank", F.col("before") + F.col("pos"))
    total = placed.count()
    if not total:
        return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell")
    #: The rows before and at each rank where a shard can end: a few hundred.
    near = candidates(total, n_shards)
    seen = {r["rank"]: (r["text_hash"], r["size"]) for r in placed.where(F.col("rank").isin([k for c in near for k in (c - 1, c)])).select("rank", "text_hash", "size").collect()} if len(near) <= 10_000 else {}
    edges = ends(total, n_shards, {c for c in near if c in seen and seen.get(c - 1) == seen[c]})
    bounds = F.array(*[F.lit(e).cast("long") for e in [0, *edges]])
    shard_no = F.size(F.filter(bounds, lambda e: e <= F.col("rank"))) - 1
    out = placed.withColumn("shard", shard_no.cast("int"))
    slot = F.col("rank") - F.get(bounds, F.col("shard"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell")


def ranges(sharded: DataFrame, docs: DataFrame) -> DataFrame:
    """Per shard: its rows and the least and largest lang, source and size, by which readers skip files."""
    rows = sharded.select("doc_id", "shard", "size").join(docs.select(F.col("doc_id").alias("d"), "lang", "source"), F.col("doc_id").eqNullSafe(F.col("d")))
    return rows.groupBy("shard").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("min", F.min), ("max", F.max))])
