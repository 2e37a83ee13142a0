"""Sets of tokens in block files, and the verification of pairs of sets against them.

Sets are dealt to blocks by a hash of their class and written once. To verify pairs, a task opens the block of the first classes and
sends each one's set, with the partners that it has there, once to every block that holds any; a task at that block opens it and
compares. What moves is a set a block of partners, not a set a pair, and sets without partners never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blobs import Roll, store
from tessera.llm.common import shared_dir, stored, tidy

PLACE = "block long, file string, offset long, length long"


class Block:
    """Classes in order, each with one or more sets (size and sorted tokens)."""

    def __init__(self, cids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]):
        self.cids, self.sizes, self.edges = cids, sizes, np.cumsum([0, *map(len, sets)])
        self.tokens = np.concatenate([*sets, np.empty(0, np.int64)])

    def dumps(self) -> bytes:
        return np.int64(len(self.cids)).tobytes() + b"".join(a.astype("<i8").tobytes() for a in (self.cids, self.sizes, self.edges, self.tokens))

    @classmethod
    def loads(cls, data: bytes) -> Block:
        made, cells = cls.__new__(cls), np.frombuffer(data, "<i8")
        m = int(cells[0])
        made.cids, made.sizes, made.edges, made.tokens = np.split(cells[1:], [m, 2 * m, 3 * m + 1])
        return made

    def of(self, cid: int) -> Iterator[tuple[int, np.ndarray]]:
        """The sets of a class."""
        for k in range(*(int(np.searchsorted(self.cids, cid, side)) for side in ("left", "right"))):
            yield int(self.sizes[k]), self.tokens[self.edges[k] : self.edges[k + 1]]


def block_of(c: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks))


def write(sets: DataFrame, tokens: int = 1 << 20) -> tuple[DataFrame, int]:
    """The index of the blocks of sets (cid, n, tokens), columns PLACE, and their number: about ``tokens`` tokens in each."""
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    blocks = max(1, -(-total // tokens))
    folder = shared_dir(sets.sparkSession) + "/sets"
    rows = sets.select(block_of(F.col("cid"), blocks).alias("block"), "cid", "n", "tokens").repartition("block").sortWithinPartitions("block", "cid")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at, held = Roll(folder, ".sets"), None, []

        def done() -> pa.RecordBatch:
            data = Block(np.array([c for c, _, _ in held], np.int64), np.array([n for _, n, _ in held], np.int64), [t for _, _, t in held]).dumps()
            file, offset = files.append(data)
            return pa.record_batch([pa.array([at], pa.int64()), pa.array([file]), pa.array([offset]), pa.array([len(data)])], [c.split()[0] for c in PLACE.split(", ")])

        for batch in batches:
            for number, cid, n, own in zip(*(batch.column(c).to_pylist() for c in ("block", "cid", "n")), batch.column("tokens"), strict=True):
                if number != at and held:
                    yield done()
                    held = []
                at = number
                held.append((cid, n, np.sort(own.values.to_numpy())))
        if held:
            yield done()
        files.close()

    return stored(rows.mapInArrow(tidy(put), PLACE)), blocks


class _Reader:
    """Blocks by place; the last one is kept."""

    def __init__(self):
        self.at, self.block = None, None

    def __call__(self, file: str, offset: int, length: int) -> Block:
        if (file, offset) != self.at:
            fs, path = store(file)
            with fs.open_input_file(path) as source:
                self.at, self.block = (file, offset), Block.loads(source.read_at(length, offset))
        return self.block


def _placed(rows: DataFrame, index: DataFrame, by: str) -> DataFrame:
    """rows with the place of block ``by``, those of one block side by side in one task or, where they are very many, in several."""
    return rows.join(index.withColumnRenamed("block", by), by).hint("rebalance", by).sortWithinPartitions("file", "offset")


def reaching(pairs: DataFrame, index: DataFrame, blocks: int, percent: int) -> DataFrame:
    """The (a, b) of pairs (a, b) of classes with sets whose intersection reaches percent of the union."""
    asked = pairs.where("a <> b").select("a", "b", block_of(F.col("a"), blocks).alias("ba"), block_of(F.col("b"), blocks).alias("bb"))
    #: Partners in one block: at most its classes.
    asked = asked.groupBy("ba", "a", "bb").agg(F.collect_set("b").alias("bs"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader()
        for batch in batches:
            out, size = [], 0
            for a, bb, bs, *place in zip(*(batch.column(c).to_pylist() for c in ("a", "bb", "bs", "file", "offset", "length")), strict=True):
                for n, own in read(*place).of(a):
                    out.append((bb, a, n, own.tobytes(), bs))
                    size += own.nbytes
                if size > 4 << 20:
                    yield _sent(out)
                    out, size = [], 0
            if out:
                yield _sent(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Reader()
        for batch in batches:
            found = []
            for a, n, packed, bs, *place in zip(*(batch.column(c).to_pylist() for c in ("a", "n", "tokens", "bs", "file", "offset", "length")), strict=True):
                own, block = np.frombuffer(packed, "<i8"), read(*place)
                for b in bs:
                    for m, other in block.of(b):
                        small, large = (own, other) if len(own) < len(other) else (other, own)
                        if (100 + percent) * len(small) < percent * (n + m) or not len(small):
                            continue
                        at = np.searchsorted(large, small)
                        both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                        if (100 + percent) * both >= percent * (n + m):
                            found.append((a, b))
                            break
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    shipped = _placed(asked, index, "ba").select("a", "bb", "bs", "file", "offset", "length").mapInArrow(tidy(send), "bb long, a long, n long, tokens binary, bs array<long>")
    return _placed(shipped, index, "bb").select("a", "n", "tokens", "bs", "file", "offset", "length").mapInArrow(tidy(compare), "a long, b long").distinct()


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bb", "a", "n", "tokens", "bs"])
