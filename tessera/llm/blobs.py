"""Files of the operators' own formats in a shared folder: writing from tasks, coalesced byte-range reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs) or of a plain path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


class Roll:
    """Appends byte strings to new files below a folder, beginning another one at ``most`` bytes.

    Each file has a name of its own, so a task that runs twice leaves an unnamed file, never a mixed one.
    """

    def __init__(self, folder: str, suffix: str, head: bytes = b"", most: int = 64 << 20):
        self.folder, self.suffix, self.head, self.most = folder.rstrip("/"), suffix, head, most
        self.out, self.name, self.at = None, "", 0

    def append(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at + len(data) > self.most and self.at > len(self.head):
            self.close()
            self.name = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}"
            fs, path = store(self.name)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.at = fs.open_output_stream(path, compression=None), len(self.head)
            self.out.write(self.head)
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def ranged(batches: Iterator[pa.RecordBatch], gap: int = 64 << 10, most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of rows (file, offset, length), sorted by file and offset, in parts of about ``most`` bytes, with the rows' bytes.

    Neighbours in a file that lie at most ``gap`` bytes apart are read at once, up to ``most`` bytes.
    """
    opened, source = None, None
    for batch in batches:
        files, at, length = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
        i = first = size = 0
        found: list[bytes] = []
        while i < len(files):
            j, end = i + 1, at[i] + length[i]
            while j < len(files) and files[j] == files[i] and 0 <= at[j] - end <= gap and at[j] + length[j] - at[i] <= most:
                end = at[j] + length[j]
                j += 1
            if opened != files[i]:
                fs, path = store(files[i])
                opened, source = files[i], fs.open_input_file(path)
            block = source.read_at(end - at[i], at[i])
            found += [block[at[k] - at[i] : at[k] - at[i] + length[k]] for k in range(i, j)]
            i, size = j, size + end - at[i]
            if size >= most:
                yield batch.slice(first, i - first), found
                first, size, found = i, 0, []
        if found:
            yield batch.slice(first), found


def dealt(index: DataFrame, chunk: int) -> DataFrame:
    """The rows of an index (file, offset, length), dealt out by file and chunk to about a task a chunk, sorted by place."""
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 0) // chunk)
    return index.repartition(max(1, tasks), "file", F.floor(F.col("offset") / chunk)).sortWithinPartitions("file", "offset")
