"""Token-id files: one zstandard frame a document, all compressed with one trained dictionary.

Documents are range-partitioned by id; each task encodes its own range in order and writes shard files. A file
begins with a magic number, the id width and the SHA-256 of the dictionary; frames follow. The index table
keeps, per document, the file, offset and length of its frame, its token count and its start among all
ids, so that a short document is read by one small range and decompressed alone.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.blobs import Roll, dealt, ranged, store
from tessera.llm.common import shared_dir, small_batches, stored, tidy

MAGIC = b"TOKZ1"
HEAD = len(MAGIC) + 1 + 32
WRITTEN = "part int, doc_id long, file string, offset long, length long, n_tokens long, before long"
TWO_GAPS, EDGE = re.compile(r"\s\s"), re.compile(r"(?<=\S)(?=[ \n])")
PLAIN = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*,.:;?|]*)")


def byte_letters() -> dict[int, str]:
    """How byte-level models write bytes: printable ones as themselves, the others, in order, from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: Stands where texts are cut; never part of UTF-8.
CUT = b"\xff"


def marked(text: str) -> bytes:
    """A text in UTF-8 with marks where it may be cut."""
    if TWO_GAPS.search(text):
        return CUT.join(piece.encode() for piece in EDGE.split(text))
    return text.encode().replace(b" ", CUT + b" ").replace(b"\n", CUT + b"\n")


def parts(text: str, size: int) -> Iterator[str]:
    """A text in parts of at least size characters that end where it may be cut."""
    at = 0
    while edge := EDGE.search(text, at + size):
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]


class Encoder:
    """Token ids as little-endian bytes, as the library gives them without special tokens of its own, through a cache of pieces.

    The byte-level pre-tokenizer never joins a character to a blank or line feed behind it, nor a letter to
    punctuation that ends a piece, so a text may be cut there and its pieces encoded alone. Texts go in blocks of about
    block characters: Arrow cuts a block and finds its different pieces, and those that the cache doesn't hold are encoded:
    plain words by the library's model, all others by its whole tokenizer. The cache is a few Arrow arrays of at most
    max_bytes; when it is full, the half that most blocks have asked for stays. Longer texts are cut into several blocks.
    Texts with an added token written out, and all texts of tokenizers of any other kind, are encoded whole.
    """

    def __init__(self, path: str, max_bytes: int = 12 << 20, max_piece: int = 64, block: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        cut = self.tokenizer.pre_tokenizer
        plain = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space and self.tokenizer.normalizer is None
        self.in_pieces = plain and isinstance(self.model, models.BPE) and self.model.dropout is None
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        letters = byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.max_bytes, self.max_piece, self.block = max_bytes, max_piece, block
        #: Pieces, their ids, and by how many blocks each was asked for.
        self.pieces, self.coded, self.asked = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """Ids of a plain word; in ASCII, only the blank in front is written differently."""
        letters = word.replace(" ", self.letters[32]) if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return self.packed([t.id for t in self.model.tokenize(letters)])

    def new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that aren't in the cache; words and punctuation in front of and behind them are encoded once each."""
        word, whole, out = cache(self.word), cache(self.whole), []
        for piece in pieces:
            if len(piece) <= self.max_piece and (m := PLAIN.fullmatch(piece)):
                feed, letters, tail = m.groups()
                ids = word(letters)
                out.append(whole(feed) + ids + whole(tail) if feed or tail else ids)
            else:
                out.append(self.whole(piece))
        return out

    def ids(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of different pieces."""
        at = pc.index_in(pieces, value_set=self.pieces)
        missing, at = pieces.filter(at.is_null()), at.fill_null(-1).to_numpy().copy()
        fresh = pa.array(self.new(missing.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        self.asked[at[at >= 0]] += 1
        at[at < 0] = len(self.coded) + np.arange(len(fresh))
        found = pa.concat_arrays([self.coded, fresh]).take(pa.array(at))
        kept = pc.less_equal(pc.utf8_length(missing), self.max_piece)
        self.pieces, self.coded = pa.concat_arrays([self.pieces, missing.filter(kept)]), pa.concat_arrays([self.coded, fresh.filter(kept)])
        self.asked = np.concatenate([self.asked, np.ones(len(self.pieces) - len(self.asked), np.int64)])
        while self.pieces.nbytes + self.coded.nbytes > self.max_bytes and len(self.pieces) > 1:
            stay = np.sort(np.argsort(-self.asked, kind="stable")[: len(self.asked) // 2])
            self.pieces, self.coded, self.asked = self.pieces.take(pa.array(stay)), self.coded.take(pa.array(stay)), self.asked[stay]
        return found

    def cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are encoded in pieces."""
        pieces = pc.split_pattern(pa.array(map(marked, texts), pa.large_binary()), CUT)
        coded = pieces.flatten().dictionary_encode()
        ids = self.ids(coded.dictionary.cast(pa.large_string())).take(coded.indices)
        _, ends, data = ids.buffers()
        at = np.frombuffer(ends, np.int64)[pieces.offsets.to_numpy()].tolist()
        return [data[a:b].to_pybytes() if a < b else b"" for a, b in pairwise(at)]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text."""
        block, size = [], 0
        for text in texts:
            alone = not self.in_pieces or self.added.search(text)
            if block and (alone or size + len(text) > self.block):
                yield from self.cut(block)
                block, size = [], 0
            if alone:
                yield self.whole(text)
            elif len(text) > self.block:
                yield b"".join(self.cut([part])[0] for part in parts(text, self.block))
            else:
                block.append(text)
                size += len(text)
        if block:
            yield from self.cut(block)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, *, sample_docs: int = 2000, sample_bytes: int = 16384, size: int = 64 << 10) -> bytes:
    """A zstandard dictionary over serialized id arrays of about sample_docs documents, or b"" if they are too few.

    The sample is drawn by a hash of the text and each array cut to sample_bytes, which bounds what the driver gets.
    Null texts don't count; repeated texts are drawn together.
    """
    import zstandard

    texts = docs.where(F.col("text").isNotNull()).select("text")
    share = sample_docs / max(1, texts.count())
    if share < 1:
        texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        end = end_id.to_bytes(e.width, "little")
        for batch in batches:
            yield pa.record_batch([pa.array([(x + end)[:sample_bytes] for x in e.encode(batch.column(0).to_pylist())], pa.binary())], ["ids"])

    samples = sorted(bytes(r[0]) for r in small_batches(texts).mapInArrow(tidy(ids), "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) > 7 else b""
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2, level: int = 3, max_file: int = 64 << 20) -> DataFrame:
    """Encodes docs (doc_id, text) into files below folder in ascending doc_id order; returns the stored index.

    Index: doc_id, file, offset, length, n_tokens (with end_id), start (ids of all documents before). Null
    texts are empty and hold end_id alone. Null ids come first; rows that repeat an id are ordered by
    a hash of their text. Long texts are cut where no token crosses. Other columns are ignored; an empty table gives an empty index.
    """
    import zstandard

    words = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(words).digest()
    fs, path = store(f"{folder}/{digest.hex()}.zdict")
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(words)
    tie = F.xxhash64("text")
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        files = Roll(folder, ".tok", MAGIC + bytes([e.width]) + digest, max_file)
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        end = end_id.to_bytes(e.width, "little")
        for batch in batches:
            out = []
            for ids in e.encode(batch.column(1).to_pylist()):
                ids += end
                data = squeeze.compress(ids)
                out.append((*files.append(data), len(data), len(ids) // e.width, before))
                before += out[-1][-2]
            names, *numbers = zip(*out, strict=True) if out else [()] * 5
            columns = [pa.array([part] * len(out), pa.int32()), batch.column(0), pa.array(names, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)]
            yield pa.record_batch(columns, [c.split()[0] for c in WRITTEN.split(", ")])
        files.close()

    written = stored(rows.mapInArrow(tidy(put), WRITTEN))
    #: One row a task: where its first id stands among all.
    parts = written.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return written.join(parts, "part").select("doc_id", "file", "offset", "length", "n_tokens", (F.col("first") + F.col("before")).alias("start"))


@lru_cache(maxsize=8)
def _opener(folder: str, digest: bytes):
    import zstandard

    fs, path = store(f"{folder}/{digest.hex()}.zdict")
    with fs.open_input_file(path) as f:
        words = f.read()
    if hashlib.sha256(words).digest() != digest:
        raise ValueError(f"damaged dictionary {path}")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)


@lru_cache(maxsize=256)
def _head(file: str) -> tuple[int, bytes]:
    fs, path = store(file)
    with fs.open_input_file(path) as f:
        head = f.read(HEAD)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"no token file: {file}")
    return head[len(MAGIC)], head[len(MAGIC) + 1 :]


def frame_ids(file: str, data: bytes) -> np.ndarray:
    """The ids of one document, as unsigned 32-bit integers."""
    width, digest = _head(file)
    raw = _opener(file.rpartition("/")[0], digest).decompress(data)
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")


def read(index: DataFrame, *, chunk: int = 16 << 20, with_ids: bool = False) -> DataFrame:
    """Per row of an index: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids, from the files.

    Any selection of an index's rows will do; null and repeated ids come back as they are, no rows give none.
    """
    places = dealt(index.select("doc_id", "start", "file", "offset", "length"), chunk)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blocks in ranged(batches):
            ids = [frame_ids(f, b) for f, b in zip(batch.column("file").to_pylist(), blocks, strict=True)]
            columns = [batch.column("doc_id"), batch.column("start"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
            if with_ids:
                columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
            yield pa.record_batch(columns, [c.split()[0] for c in schema.split(", ")])

    return places.mapInArrow(tidy(get), schema)


def report(docs: DataFrame, tokenizer: str, *, end_id: int = 2) -> DataFrame:
    """Writes the files to a shared folder and returns what they hold, read back."""
    return read(write(docs, shared_dir(docs.sparkSession) + "/tokens", tokenizer, end_id=end_id))
