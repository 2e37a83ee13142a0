"""What the training-data operators share: word rules, shared folders, tables that cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.store import shared_dir, stored

__all__ = ["SPACE_CHARS", "SPACE_CLASS", "ascii_lower", "bounded", "give_back", "join_hot", "repeated", "shared_dir", "small_batches", "space_words", "split_words", "stored", "table", "tidy", "unused"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: ASCII white space, as a Java character class body and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Spark's setting of the bytes of an Arrow batch, and its default.
ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(df: DataFrame, most: str = "4m") -> DataFrame:
    """df; from now on its session hands Python workers Arrow batches of about ``most`` bytes, whatever the rows hold.

    A size that the user has set stays.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_BYTES) == ARROW_DEFAULT:
        conf.set(ARROW_BYTES, most)
    return df


def give_back() -> None:
    """Returns memory that a task's Python code has freed to the system: the worker outlives its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a partition's batches that gives memory back when it is through."""

    def done(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is (``lower`` would also change other letters)."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, gap: str) -> Column:
    """Array of the words between runs that match ``gap``; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gap), lambda w: w != "")


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def bounded(df: DataFrame, max_rows: int) -> bool:
    """Whether a frame has at most max_rows rows, found without reading more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def unused(columns: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that are not among columns, upper and lower case being the same."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def repeated(df: DataFrame, times: Column, block: int = 10_000) -> DataFrame:
    """Every row as often as ``times`` says, in steps of bounded arrays; rows with null, 0 or less go."""
    n, at = unused(df.columns, "n", "at")
    rows = df.withColumn(n, times.cast("long")).where(F.col(n) > 0)
    rows = rows.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / block))))
    return rows.withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block), F.col(n) - F.col(at) * block)))).drop(n, at)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], by: str, *, how: str = "inner", part_rows: int = 2000, most_keys: int = 10000) -> DataFrame:
    """left joined with right on keys, where right has few rows a key and left may have very many.

    left must be stored. Keys with more than part_rows rows of left, and more than its most_keys-th part, are hot: at most
    most_keys of them, which bounds their broadcast. Their rows are dealt out by a hash of the column ``by``
    over parts of about part_rows rows, and those of right are repeated for each part.
    """
    part, rows = unused([*left.columns, *right.columns], "part", "rows")
    hot = stored(left.groupBy(*keys).agg(F.count("*").alias(rows)).where(F.col(rows) > part_rows))
    n = hot.count()
    if not n:
        return left.join(right, keys, how)
    if n > most_keys:
        hot = hot.where(F.col(rows) > left.count() // most_keys)
    parts = F.coalesce(F.least(F.ceil(F.col(rows) / part_rows), F.lit(1 << 14)), F.lit(1)).cast("long")
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn(part, F.pmod(F.xxhash64(by), parts)).drop(rows)
    spread = right.join(F.broadcast(hot), keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(rows)
    return dealt.join(spread, [*keys, part], how).drop(part)
