"""Exact duplicates by digest against a history that is indexed by minimal perfect hashes.

The history's distinct digests are dealt into buckets by their first bits. Each bucket becomes one row of the index: a minimal
perfect hash, and its slots with the full digest, the winner's locator (id and row number) and the group's size. Rows of a new batch
are summed up inside their tasks, travel to their bucket, and are asked for there: a slot counts only if its 32 bytes are
those of the row. Hits join the slot's group, and with that repeats of the history are removed; rows that are no
members are grouped by digest among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, small_batches, stored, tidy, unused
from tessera.llm.perfecthash import PerfectHash, words

ROWS = "digest binary, doc_id long, row long, n long"
INDEX = "bucket int, hash binary, digests binary, doc_ids binary, rows binary, sizes binary"
FOUND = "member boolean, digest binary, doc_id long, row long, n long"
#: Stands for a null id in packed slots: it loses against every other id.
NO_ID = -(1 << 63)


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest words, ids, row numbers and counts of a batch that begins with the columns of ROWS."""
    ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return words(b"".join(batch.column("digest").to_pylist())), ids, batch.column("row").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)


def _batch(keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(keys), [None, pa.py_buffer(keys.astype(">u8").tobytes())])
    cells = {k: pa.array(v) for k, v in more.items()}
    cells |= {"digest": raw.cast(pa.binary()), "doc_id": pa.array(ids, mask=ids == NO_ID), "row": pa.array(rows), "n": pa.array(n)}
    return pa.record_batch(list(cells.values()), list(cells))


def _summed(keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One line a digest, in order: the last locator by id and row number, and the sum of counts."""
    order = np.lexsort((rows, ids, *keys.T[::-1]))
    keys, ids, rows, n = keys[order], ids[order], rows[order], n[order]
    last = np.ones(len(keys), bool)
    last[:-1] = (keys[1:] != keys[:-1]).any(axis=1)
    ends = np.flatnonzero(last)
    total = np.cumsum(n)[ends]
    return keys[ends], ids[ends], rows[ends], np.diff(total, prepend=0)


def groups(rows: DataFrame) -> DataFrame:
    """(digest, doc_id, row, n): of each digest the locator with the largest id, then row number, and the count."""
    best = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.sum("n").alias("n"))
    return best.select("digest", F.col("top.doc_id").alias("doc_id"), F.col("top.row").alias("row"), "n")


def preadded(rows: DataFrame, lines: int = 200_000) -> DataFrame:
    """Rows (digest, doc_id, row, n) summed up inside their tasks, ``lines`` of them at a time; a hot digest moves about once a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            held.append(_columns(batch))
            size += batch.num_rows
            if size >= lines:
                done = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                #: Summing again pays only where most lines went.
                if len(done[0]) > lines // 2:
                    yield _batch(*done)
                    held, size = [], 0
                else:
                    held, size = [done], len(done[0])
        if size:
            yield _batch(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return rows.select("digest", "doc_id", "row", "n").mapInArrow(tidy(add), ROWS)


def build(history: DataFrame, buckets: int) -> DataFrame:
    """The index over the distinct digests of groups (digest, doc_id, row, n): one row a bucket that has any.

    A bucket is built in memory, at 56 bytes a digest: choose buckets so that it has some thousands.
    """
    rows = history.select(bucket(buckets).alias("bucket"), "digest", "doc_id", "row", "n").repartition("bucket").sortWithinPartitions("bucket")

    def made(number: int, parts: list[tuple]) -> pa.RecordBatch:
        keys, ids, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        function = PerfectHash.of(keys)
        order = np.empty(len(keys), np.int64)
        order[function.slots(keys)] = np.arange(len(keys))
        cells = [function.dumps(), keys[order].astype(">u8").tobytes(), *(x[order].astype("<i8").tobytes() for x in (ids, at, n))]
        return pa.record_batch([pa.array([number], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], [c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            number = batch.column("bucket").to_numpy()
            for part in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                if not len(part):
                    continue
                if number[part[0]] != now and parts:
                    yield made(now, parts)
                    parts = []
                now = number[part[0]]
                parts.append(_columns(batch.slice(part[0], len(part))))
        if parts:
            yield made(now, parts)

    return rows.mapInArrow(tidy(run), INDEX)


class _Bucket:
    """A row of the index in memory, with what a batch adds to its slots."""

    def __init__(self, row: dict):
        self.hash = PerfectHash.loads(row["hash"])
        self.keys = words(row["digests"])
        self.ids, self.rows, self.sizes = (np.frombuffer(row[c], "<i8").copy() for c in ("doc_ids", "rows", "sizes"))

    def admit(self, keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Adds the lines that are members to their groups; returns which ones are."""
        slot = self.hash.slots(keys)
        member = slot >= 0
        member[member] = (self.keys[slot[member]] == keys[member]).all(axis=1)
        _, ids, rows, n = _summed(keys[member], ids[member], rows[member], n[member])
        at = np.unique(slot[member])
        order = np.lexsort(self.keys[at].T[::-1])  # that of _summed
        at = at[order]
        later = (ids > self.ids[at]) | ((ids == self.ids[at]) & (rows > self.rows[at]))
        self.ids[at], self.rows[at] = np.where(later, ids, self.ids[at]), np.where(later, rows, self.rows[at])
        self.sizes[at] += n
        return member

    def lines(self) -> pa.RecordBatch:
        return _batch(self.keys, self.ids, self.rows, self.sizes, member=np.ones(len(self.keys), bool)).select([c.split()[0] for c in FOUND.split(", ")])


def admitted(index: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """(member, digest, doc_id, row, n): every group of the index with what rows (digest, doc_id, row, n) add to it, and as
    lines that are no members the other rows, still to be grouped by digest.

    Rows and index meet by bucket, the index's row first; rows stream through, so that a task holds one bucket of the index
    and one batch of rows, however many there are.
    """
    names = [c.split()[0] for c in INDEX.split(", ")]
    asked = rows.select(bucket(buckets).alias("bucket"), F.lit(1).alias("side"), "digest", "doc_id", "row", "n")
    both = index.select("*", F.lit(0).alias("side")).unionByName(asked, allowMissingColumns=True)
    both = both.select(*names, "side", "digest", "doc_id", "row", "n").repartition("bucket").sortWithinPartitions("bucket", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_bucket = None, None
        for batch in batches:
            number, side = batch.column("bucket").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(side) != 0)) + 1
            for part in np.split(np.arange(len(number)), cuts):
                if not len(part):
                    continue
                if number[part[0]] != now:
                    if open_bucket is not None:
                        yield open_bucket.lines()
                    now, open_bucket = number[part[0]], None
                own = batch.slice(part[0], len(part))
                if side[part[0]] == 0:
                    open_bucket = _Bucket({c: own.column(c)[0].as_py() for c in names})
                    continue
                cells = _columns(own)
                other = np.ones(len(part), bool) if open_bucket is None else ~open_bucket.admit(*cells)
                if other.any():
                    yield _batch(*(x[other] for x in cells), member=np.zeros(int(other.sum()), bool)).select([c.split()[0] for c in FOUND.split(", ")])
        if open_bucket is not None:
            yield open_bucket.lines()

    return both.mapInArrow(tidy(run), FOUND)


def merged(index: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """(digest, doc_id, row, n): the groups of history and rows together; ``build`` over them is the index for the next batch."""
    found = stored(admitted(index, preadded(rows), buckets))
    lines = [c.split()[0] for c in ROWS.split(", ")]
    return found.where("member").select(*lines).unionByName(groups(found.where("NOT member")).select(*lines))


def halves(docs: DataFrame) -> Column:
    """Whether a document is of the older half of the range of ids; null ids are new."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(False) if low is None else F.coalesce(F.col("doc_id") <= (low + high) // 2, F.lit(False))


def dedup(docs: DataFrame, old: Column | None = None, *, per_bucket: int = 2000, most: int = 200_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Rows for which ``old`` holds (left out: the older half of the range of ids) are the history that is indexed; the others are asked
    for in it. Of equal texts the row with the largest doc_id stays, whichever part it is in; of rows that share that id, too,
    one stays. A null text counts as empty; a null id loses against all others, and where all ids of a group are null
    keep_id is null and one row stays. Texts of any length are read whole; other columns are ignored; an empty table gives no rows.
    """
    old = halves(docs) if old is None else old
    rows = docs.withColumn(is_old := unused(docs.columns, "old")[0], old)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), F.col(is_old).alias("old"))
    #: Row numbers hold once the table is written.
    rows = small_batches(stored(rows.withColumn("row", F.monotonically_increasing_id())))
    lines = rows.withColumn("n", F.lit(1).cast("long"))
    buckets = max(1, -(-rows.count() // per_bucket))
    index = stored(build(groups(preadded(lines.where("old"))), buckets))
    twice = stored(merged(index, lines.where("NOT old"), buckets).where("n > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size")))
    size, own = F.coalesce("group_size", F.lit(1)), F.col("group_size").isNull()
    out = _with_group(rows, twice, most)
    return out.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), size.cast("long").alias("group_size"), (own | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _with_group(rows: DataFrame, twice: DataFrame, most: int) -> DataFrame:
    """rows with their group from twice, null where a digest doesn't repeat.

    Up to ``most`` groups are broadcast. Where there are more, groups of more than rows / most rows are, which are at most ``most``,
    and only the rows of the others, few to a digest, are joined by shuffling.
    """
    if bounded(twice, most):
        return rows.join(F.broadcast(twice), "digest", "left")
    often = F.col("group_size") > rows.count() // most
    hot = rows.join(F.broadcast(twice.where(often)), "digest", "left")
    cells = ["keep_id", "keep_row", "group_size"]
    rare = hot.where("group_size IS NULL").drop(*cells).join(twice.where(~often), "digest", "left")
    return hot.where("group_size IS NOT NULL").unionByName(rare)
