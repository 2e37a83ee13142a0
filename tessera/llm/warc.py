"""WARC archives: written by tasks, indexed by record, read back by coalesced byte ranges.

Every page becomes one gzip member of a WARC/1.1 file: a response with the page's bytes or, where another
page with the same bytes stands for it, a revisit. The index (file, offset, length, URL, digest) comes
first; readers select records from it, sort them by place and fetch neighbouring records in one read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blobs import Roll, dealt, ranged
from tessera.llm.common import bounded, shared_dir, small_batches, stored, tidy

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PAGE = "urn:page:"


#: Arrow types of both tables' columns.
TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(x, TYPES[kind]) for x, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit (refers_to given) holds the HTTP head alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{PAGE}{'null' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": f"<{PAGE}{refers_to}>" if revisit else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The columns of RECORD from one record's bytes; a response's payload must match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    said = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(said["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, url = said["WARC-Payload-Digest"].removeprefix("sha1:"), said.get("WARC-Target-URI")
    page = lambda x: None if x is None or x == f"<{PAGE}null>" else int(x[len(PAGE) + 1 : -1])
    if said["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {said['WARC-Record-ID']}")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return page(said["WARC-Record-ID"]), url, size, digest, said["WARC-Type"], page(said.get("WARC-Refers-To")), payload if said["WARC-Type"] == "response" else None


def write(pages: DataFrame, folder: str, *, min_bytes: int = 0, max_file: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives pages (page_id, url, html) below folder and returns the stored index, one row a page.

    Of pages with equal bytes (at least min_bytes of them) the one with the largest page_id is the response,
    the others revisit it. A null html is an empty payload; a null page_id never stands for others, and
    where all ids of equal pages are null all are responses; so are rows that repeat the largest page_id, and these
    share its record id. Other columns are ignored, an empty table gives an empty index.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.length("payload")})
    #: Only what repeats, without its bytes; hot payloads are summed up before the shuffle.
    twice = rows.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    twice = stored(twice.select("sha", "size", "first", "n"))
    rows = _with_first(rows, twice)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = small_batches(rows.select("page_id", "url", "payload", refers.alias("refers_to")))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Roll(folder, ".warc.gz", most=max_file)
        for batch in batches:
            out = []
            for page_id, url, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                data = gzip.compress(record(page_id, url, payload, digest, refers_to, date), 6, mtime=0)
                file, at = files.append(data)
                out.append((page_id, url, file, at, len(data), digest, len(payload), "response" if refers_to is None else "revisit", refers_to))
            yield _batch(out, INDEX)
        files.close()

    return stored(rows.mapInArrow(tidy(put), INDEX))


def _with_first(rows: DataFrame, twice: DataFrame, most: int = 200_000) -> DataFrame:
    """rows with ``first`` from twice (sha, size, first, n), null where a payload doesn't repeat.

    Up to ``most`` repeated payloads are broadcast. Where they are more, those with more than rows / most rows are, which are
    at most ``most``, and only the others, with few pages each, are joined by shuffling.
    """
    small = twice.select("sha", "size", "first")
    if bounded(twice, most):
        return rows.join(F.broadcast(small), ["sha", "size"], "left")
    often = F.col("n") > rows.count() // most
    hot = rows.join(F.broadcast(small.where(often).withColumnRenamed("first", "hot")), ["sha", "size"], "left")
    hot = hot.withColumn("key", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.xxhash64("page_id", "url").cast("string")))
    rare = small.where(~often).withColumnsRenamed({"sha": "key", "size": "s"})
    same = (hot["key"] == rare["key"]) & (F.col("size") == F.col("s"))
    return hot.join(rare, same, "left").withColumn("first", F.coalesce("hot", "first"))


def read(index: DataFrame, *, chunk: int = 32 << 20, gap: int = 64 << 10) -> DataFrame:
    """The records that the rows of an index name, parsed from the archives, in the columns of RECORD.

    Selected records are dealt out by file and chunk, sorted by offset and fetched in coalesced ranges. Any selection of an
    index's rows will do; a row that is named twice is read twice, no rows give none. Null ids and urls come back as null, and
    so does the payload of a revisit.
    """
    places = dealt(index.select("file", "offset", "length"), chunk)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in ranged(batches, gap):
            yield _batch([parse(gzip.decompress(b)) for b in blocks], RECORD)

    return places.mapInArrow(tidy(get), RECORD)


def report(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Writes the archives to a shared folder and returns what they hold: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index = write(pages, shared_dir(pages.sparkSession) + "/warc", min_bytes=min_bytes)
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
