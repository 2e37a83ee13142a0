"""N-gram Jaccard join by grouped prefixes, and the components of its links.

1. Tasks turn texts into sets of distinct shingles (64-bit hashes of word n-grams) and pack those of about half a million
   shingles, a chunk, into bins of the hash range. A bin counts its shingles and sends those that occur more than once, with
   their counts, back to their chunks. A shingle of one text alone costs seven bytes of shuffle and goes no further.
2. All sets follow one order, rarest shingle first, then by hash. A set's prefix is its first
   size - ceil(t * size) + 1 shingles. Two sets that link share one of them, so a set whose prefix is all unique has no
   link; of the others only the shared shingles are kept, which hold every overlap. Equal sets form one class.
3. Classes of one size and with the same shared shingles in their prefixes form a group. Groups that share a prefix
   shingle, each group with itself too, are pairs if sizes, places and the number of common prefix shingles allow the similarity.
4. Pairs are expanded to their members, and these verified. This is not done for all pairs at once: for a few turns every list of
   groups is compared with a few leaders, other ones each time, and what is found so is contracted to components; in the
   end all pairs of groups that are not within one component are expanded to all pairs of members of different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import setblocks
from tessera.llm.common import small_batches, stored, tidy, unused
from tessera.llm.components import components

MIX = np.uint64(0x9E3779B97F4A7C15)

#: Bits of a shingle's hash within its bin; bytes of a shingle on its way to the bin, and on its way back.
LOW_BITS, OUT_BYTES, BACK_BYTES = 40, 7, 9

#: A document on its way: its id and whether it has one, the size of its set and its class in the chunk (-1: none).
DOC = np.dtype([("doc_id", "<i8"), ("named", "?"), ("n", "<i8"), ("class", "<i4")])

SIGNED = "doc_id long, n long, rep long, chunk long, digest binary, gid binary, prefix array<long>, tokens array<long>"


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than ``size`` make one, none make none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_length(n: int, percent: int) -> int:
    """n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1 if n else 0


class Chunk:
    """The sets of some documents until they are sent to the bins."""

    def __init__(self, bins: int):
        self.bits, self.n_tokens = bins.bit_length() - 1, 0
        self.docs: list[tuple[int, bool, int, int]] = []
        self.classes: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        import xxhash

        at = -1
        if doc_id is not None and len(tokens):
            digest = xxhash.xxh3_128_digest(tokens.tobytes())
            at = self.classes.setdefault(digest, len(self.classes))
            if at == len(self.sets):
                self.sets.append(tokens)
                self.n_tokens += len(tokens)
        self.docs.append((doc_id or 0, doc_id is not None, len(tokens), at))

    def rows(self, number: int) -> pa.RecordBatch:
        """(bin, chunk, packed): one row a bin with its shingles, and one with the documents, which has no shingle.

        The chunk's name is a hash of its number and documents, so parts of different attempts never mix.
        """
        import xxhash

        bins, low = np.uint64(64 - self.bits), np.uint64(64 - self.bits - LOW_BITS)
        every = np.concatenate([*self.sets, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(self.sets), dtype=np.uint16), [len(s) for s in self.sets])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        edges = np.searchsorted(every >> bins, np.arange((1 << self.bits) + 1, dtype=np.uint64))
        used = np.flatnonzero(np.diff(edges))
        token = (every >> low) & np.uint64((1 << LOW_BITS) - 1)
        high, last = (token >> np.uint64(8)).astype("<u4"), token.astype(np.uint8)
        docs = np.array(self.docs, DOC).tobytes()
        head = np.array([len(used), len(self.docs)], "<i8").tobytes() + docs + b"".join(self.classes)
        name = xxhash.xxh3_64_intdigest(head, seed=number & 0xFFFFFFFFFFFFFFFF) >> 1
        packed = [high[a:b].tobytes() + last[a:b].tobytes() + owner[a:b].tobytes() for a, b in zip(edges[used], edges[used + 1], strict=True)]
        where = np.r_[used, name % (1 << self.bits)]
        parts = [pa.array(where, pa.int32()), pa.array(np.full(len(where), name), pa.int64()), pa.array([*[False] * len(used), True]), pa.array([*packed, head], pa.binary())]
        return pa.record_batch(parts, ["bin", "chunk", "is_head", "packed"])


def _counted(number: int, chunks: list[int], parts: list[bytes], most: int = 1 << 22) -> pa.RecordBatch:
    """The shingles of one bin that occur in several sets, back to their chunks, with their counts up to 65,535.

    Parts are in order, so a bin is counted by ranges of about ``most`` shingles; between ranges it costs nine bytes a shingle.
    """
    sizes = [len(p) // OUT_BYTES for p in parts]
    turns = max(1, -(-sum(sizes) // most))
    limits = np.array([(1 << LOW_BITS) * k // turns for k in range(turns + 1)], np.uint64)
    token = lambda p, k: np.frombuffer(p, "<u4", k).astype(np.uint64) << np.uint64(8) | np.frombuffer(p, np.uint8, k, 4 * k)
    cuts = [np.searchsorted(token(p, k), limits) for p, k in zip(parts, sizes, strict=True)]
    times = [np.empty(k, "<u2") for k in sizes]
    for turn in range(turns):
        spans = [slice(c[turn], c[turn + 1]) for c in cuts]
        own = np.concatenate([token(p, k)[s] if turns > 1 else token(p, k) for p, k, s in zip(parts, sizes, spans, strict=True)])
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        first = np.flatnonzero(np.r_[np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1]])
        count = np.diff(np.r_[first, len(ranked)])
        n = np.empty(len(own), "<u2")
        n[order] = np.repeat(np.minimum(count, 65535), count)
        at = 0
        for s, t in zip(spans, times, strict=True):
            t[s] = n[at : at + s.stop - s.start]
            at += s.stop - s.start
    out = []
    for p, k, t in zip(parts, sizes, times, strict=True):
        keep = np.flatnonzero(t > 1)
        out.append(np.frombuffer(p, "<u4", k)[keep].tobytes() + np.frombuffer(p, np.uint8, k, 4 * k)[keep].tobytes() + np.frombuffer(p, "<u2", k, 5 * k)[keep].tobytes() + t[keep].tobytes())
    m = len(out)
    return pa.record_batch([pa.array(chunks, pa.int64()), pa.array([number] * m, pa.int32()), pa.array([False] * m), pa.array(out, pa.binary())], ["chunk", "bin", "is_head", "packed"])


def _ragged(arrays: list[np.ndarray]) -> pa.ListArray:
    edges = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)]), pa.int64()))


def _signed(chunk: int, head: bytes, bins: list[int], parts: list[bytes], percent: int) -> pa.RecordBatch:
    """The rows of one chunk in the columns of SIGNED."""
    import xxhash

    n_parts, n_docs = np.frombuffer(head, "<i8", 2)
    if n_parts != len(parts):
        raise ValueError("documents came in another order when a lost task was run again: join() wants a stored table")
    docs = np.frombuffer(head, DOC, n_docs, 16)
    digests = head[16 + DOC.itemsize * n_docs :]
    sizes = [len(p) // BACK_BYTES for p in parts]
    token = np.concatenate([np.uint64(b << LOW_BITS) | np.frombuffer(p, "<u4", k).astype(np.uint64) << np.uint64(8) | np.frombuffer(p, np.uint8, k, 4 * k) for b, p, k in zip(bins, parts, sizes, strict=True)] or [np.empty(0, np.uint64)]).astype(np.int64)
    owner, n = (np.concatenate([np.frombuffer(p, "<u2", k, at * k) for p, k in zip(parts, sizes, strict=True)] or [np.empty(0, "<u2")]) for at in (5, 7))
    order = np.lexsort((token, n, owner))
    token = token[order]
    edges = np.searchsorted(owner[order], np.arange(len(digests) // 16 + 1))
    rep = np.full(len(digests) // 16, np.iinfo(np.int64).max)
    linked = docs["class"] >= 0
    np.minimum.at(rep, docs["class"][linked], docs["doc_id"][linked])
    none, seen = np.empty(0, np.int64), set()
    reps, marks, gids, prefixes, sets = [], [], [], [], []
    for doc_id, k, size in zip(docs["doc_id"].tolist(), docs["class"].tolist(), docs["n"].tolist(), strict=True):
        first = k >= 0 and doc_id == rep[k] and k not in seen
        own = token[edges[k] : edges[k + 1]] if first else none
        open_ = own[: max(0, prefix_length(size, percent) - (size - len(own)))]
        if first:
            seen.add(k)
        reps.append(int(rep[k]) if k >= 0 else None)
        marks.append(digests[16 * k : 16 * k + 16] if first else None)
        gids.append(xxhash.xxh3_128_digest(size.to_bytes(8, "little") + open_.tobytes()) if len(open_) else None)
        prefixes.append(open_)
        sets.append(own if len(open_) else none)
    ids = pa.array(docs["doc_id"], pa.int64(), mask=~docs["named"])
    columns = [ids, pa.array(docs["n"]), pa.array(reps, pa.int64()), pa.array(np.full(n_docs, chunk), pa.int64()), pa.array(marks, pa.binary()), pa.array(gids, pa.binary()), _ragged(prefixes), _ragged(sets)]
    return pa.record_batch(columns, [c.split()[0] for c in SIGNED.split(", ")])


def signatures(docs: DataFrame, *, size: int, percent: int, bins: int, chunk_tokens: int) -> DataFrame:
    """Per row of docs (doc_id, text), which must be a stored table: the columns of SIGNED.

    n: size of the set. rep: least doc_id with this set in the chunk, null for empty sets and null ids. digest: of the set, in the
    first row of rep alone, as are the following: gid, of size and prefix; prefix: its shingles that other sets have;
    tokens: all such shingles. These three are empty if the prefix is unique.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = Chunk(bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).cast(pa.int64()).to_pylist(), batch.column(1), strict=True):
                held.add(doc_id, shingles(text.as_py(), size))
                if held.n_tokens >= chunk_tokens or len(held.docs) == 1 << 16:
                    yield held.rows(number)
                    held, number = Chunk(bins), number + 1
        if held.docs:
            yield held.rows(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunks, parts = -1, [], []
        for batch in batches:
            for number, chunk, is_head, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if number != at and parts:
                    yield _counted(at, chunks, parts)
                    chunks, parts = [], []
                at = number
                if is_head:
                    yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), pa.array([True]), pa.array([packed], pa.binary())], ["chunk", "bin", "is_head", "packed"])
                else:
                    chunks.append(chunk)
                    parts.append(packed)
        if parts:
            yield _counted(at, chunks, parts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, numbers, parts = -1, b"", [], []
        for batch in batches:
            for chunk, number, is_head, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if is_head:  # the first row of a chunk
                    if head:
                        yield _signed(at, head, numbers, parts, percent)
                    at, head, numbers, parts = chunk, packed, [], []
                elif chunk != at:
                    raise ValueError("documents came in another order when a lost task was run again: join() wants a stored table")
                else:
                    numbers.append(number)
                    parts.append(packed)
        if head:
            yield _signed(at, head, numbers, parts, percent)

    packed = small_batches(docs).select("doc_id", "text").mapInArrow(tidy(pack), "bin int, chunk long, is_head boolean, packed binary")
    counted = packed.repartition("bin").sortWithinPartitions("bin").mapInArrow(tidy(count), "chunk long, bin int, is_head boolean, packed binary")
    return counted.repartition("chunk").sortWithinPartitions("chunk", "bin").mapInArrow(tidy(sign), SIGNED)


def _reaches(overlap: Column, percent: int) -> Column:
    """Whether so many common shingles reach the similarity at the sizes nx and ny."""
    return (100 + percent) * overlap >= percent * (F.col("nx") + F.col("ny"))


def _near(percent: int) -> Column:
    """Whether the sizes, and what follows a common shingle in both sets, allow the similarity.

    All sets follow one order. The first shingle that two sets have in common has the whole overlap at and after it, so pairs
    that link pass there; later common shingles pass until too little is left, which makes those that pass the first ones:
    their number and what follows the last of them bound the overlap.
    """
    return (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & _reaches(1 + F.least("restx", "resty"), percent)


def _one_root(*names: str) -> Column:
    """Whether all members of the groups are of one component."""
    return F.least(*[f"lo{c}" for c in names]) == F.greatest(*[f"hi{c}" for c in names])


def _side(lists: DataFrame, name: str, *more: str) -> DataFrame:
    return lists.select("token", *more, *[F.col(c).alias(c + name) for c in ("gid", "n", "rest", "open", "lo", "hi")])


def _bounded_pairs(found: DataFrame, percent: int, few: Column | None = None) -> DataFrame:
    """(gidx, gidy, both, open) of the rows of found, one row a common shingle, whose common shingles leave the similarity open."""
    pairs = found.groupBy("gidx", "nx", "gidy", "ny").agg(F.count("*").alias("both"), F.min(F.least("restx", "resty")).alias("more"), F.max("c").alias("c"), F.max("openx").alias("open"))
    enough = _reaches(F.col("both") + F.col("more"), percent)
    return pairs.where(enough if few is None else enough | ~few).select("gidx", "gidy", "both", "open")


def _with_leaders(lists: DataFrame, turn: int, leaders: int, percent: int, hot_from: int) -> DataFrame:
    """Pairs of groups: the members of each list and size band with its leaders, unless both are of one component.

    Of the leaders one half has the most shared shingles in the prefix, of all groups or of a random quarter: what such a set
    holds, its near copies hold too, so even copies that are far from each other are near to it. The others are random. They
    change in every turn; bands move by half their width. A list of up to ``leaders`` groups is nearly covered, so pairs of
    such lists must also share enough of their prefixes. Of all leaders of its lists a group keeps those with which it shares
    most and which have most shared shingles, and ``leaders`` others at most, so pairs grow with the groups, not with the lists.
    Long lists are dealt out in parts. What is left out here is compared in the end.
    """
    band = F.floor(F.ln("n") / F.lit(log(100 / percent)) + F.lit(turn % 2 / 2))
    rows = lists.withColumn("band", band)
    one = F.struct("gid", "n", "rest", "open", "lo", "hi")
    mark = lambda k: F.xxhash64("gid", F.lit(turn * leaders + k))
    rich = lambda k: F.max_by(one, F.when(F.lit(k + turn == 0) | (F.pmod(mark(k), F.lit(4)) == 0), F.struct("open", mark(k))))
    chosen = [(F.min_by(one, mark(k)) if k % 2 else rich(k)).alias(f"l{k}") for k in range(leaders)]
    parts = F.ceil(F.col("c") / hot_from)
    lead = rows.groupBy("token", "band").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.max("c").alias("c"), *chosen).where("least <> most")
    lead = lead.select("token", "band", "c", F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(leaders)]))).alias("x")).where("x IS NOT NULL")
    lead = lead.select("token", "band", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), *[F.col(f"x.{c}").alias(c + "x") for c in ("gid", "n", "rest", "open", "lo", "hi")])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("gid"), parts))
    pairs = _side(rows, "y", "band", "part", "c").join(lead, ["token", "band", "part"])
    pairs = pairs.where((F.col("gidx") != F.col("gidy")) & ~_one_root("x", "y") & _near(percent))
    pairs = _bounded_pairs(pairs, percent, F.col("c") <= leaders)
    best = [F.max_by("gidx", F.struct(c, F.xxhash64("gidx"))) for c in ("both", "open")]
    others = [F.min_by("gidx", F.xxhash64("gidx", F.lit(turn * leaders + k))) for k in range(leaders)]
    return pairs.groupBy("gidy").agg(F.array_distinct(F.array(*best, *others)).alias("xs")).select(F.explode("xs").alias("gidx"), "gidy")


def _all_pairs(lists: DataFrame, percent: int, hot_from: int) -> DataFrame:
    """All pairs of groups of a list that are not of one component, the first the smaller one or the one with the lesser gid.

    Sizes that allow the similarity lie in one band or in the next. Long lists are dealt out in parts.
    """
    parts = F.ceil(F.col("c") / hot_from)
    rows = lists.join(_mixed(lists), "token").withColumn("band", F.floor(F.ln("n") / F.lit(log(100 / percent))))
    right = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    right = _side(right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), "y", "band", "part")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("gid"), parts))
    first = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("gidx") < F.col("gidy")))
    pairs = _side(rows, "x", "band", "part", "c").join(right, ["token", "band", "part"]).where(first & ~_one_root("x", "y") & _near(percent))
    return _bounded_pairs(pairs, percent).select("gidx", "gidy")


def _mixed(rows: DataFrame) -> DataFrame:
    """The lists of rows (token, lo, hi) that are not within one component, by token."""
    return rows.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("token")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) with more links (a, b) between nodes."""
    named = links
    for c in "ab":
        named = named.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
    moved = components(named).select(F.col("node").alias("old"), F.col("root").alias("new"))
    now = roots.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return stored(now.unionByName(moved.select(F.col("old").alias("node"), F.col("new").alias("root"))))


def join(docs: DataFrame, *, size: int = 5, percent: int = 75, bins: int | None = None, chunk_tokens: int = 1 << 19, hot_from: int = 500, rounds: int = 4, leaders: int = 4) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    docs must be a stored table. Documents link when 100 * intersection >= percent * union; component_id is the smallest
    doc_id reachable by links. Texts that are null or have no words are empty, link with nothing and keep their own id,
    as does a null doc_id (which then stands for no component). Rows that repeat a doc_id share its smallest component, also
    where their texts differ. Long texts are shingled whole. Empty tables give no rows; other columns are ignored.

    bins (a power of two) defaults to one for about a million shingles; lists of more than hot_from groups are dealt to several
    tasks.
    """
    if bins is None:
        about = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bins = min(1 << 18, max(1 << 10, 1 << (about >> 23).bit_length()))
    signed = stored(signatures(docs, size=size, percent=percent, bins=bins, chunk_tokens=max(chunk_tokens, 64 * bins)))
    #: Equal sets: one class per digest, named by its least doc_id. A chunk has one row of each.
    heads = signed.where("digest IS NOT NULL")
    classes = stored(heads.groupBy("digest").agg(F.min(F.struct("rep", "chunk")).alias("x")).select("digest", "x.rep", "x.chunk"))
    named = heads.select("digest", F.col("rep").alias("node")).join(classes.select("digest", F.col("rep").alias("root")), "digest")
    #: node, root: of chunks' names for classes, later of all linked names. A doc_id with several texts may stand for several.
    named = named.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other"))
    named = stored(named.where("node <> root OR root <> other"))
    roots = named.select("node", "root").where("node <> root")

    #: Classes with a shared shingle in their prefix. A doc_id with several texts may name several of them.
    open_ = heads.where("gid IS NOT NULL").select("digest", "chunk", "n", "gid", "prefix", "tokens")
    sets = stored(open_.join(classes, ["digest", "chunk"]).select(F.col("rep").alias("cid"), "gid", "n", "prefix", "tokens"))
    members = sets.select("gid", "cid")
    index, blocks = setblocks.write(sets)
    #: Lists: the groups that have a shingle in their prefix, where they are several. rest: shingles after it in the set's order.
    lists = sets.select("gid", "n", "prefix").dropDuplicates(["gid"]).select("gid", "n", F.size("prefix").alias("open"), F.posexplode("prefix").alias("at", "token"))
    lists = lists.select("token", "gid", "n", F.expr(f"(n * {percent} + 99) DIV 100 - 2 + open - at").alias("rest"), "open")
    several = lists.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    lists = stored(lists.join(several, "token"))

    for turn in range(rounds):
        rooted = _rooted(members, roots)
        groups = _spans(rooted)
        rows = lists.join(groups, "gid")
        if turn:  # a list that lies within one component stays so: later turns leave it out
            rows = stored(rows.join(_mixed(rows), "token", "left_semi"))
            lists = rows.drop("lo", "hi")
        apart = _with_leaders(rows, turn, leaders, percent, hot_from)
        pairs = apart.unionByName(groups.where("lo <> hi").select(F.col("gid").alias("gidx"), F.col("gid").alias("gidy")))
        one = rooted.groupBy("gid").agg(F.min_by(F.struct("cid", "root"), F.xxhash64("cid", F.lit(turn))).alias("x"))
        one = one.select(F.col("gid").alias("gidx"), F.col("x.cid").alias("a"), F.col("x.root").alias("ra"))
        every = rooted.select(F.col("gid").alias("gidy"), F.col("cid").alias("b"), F.col("root").alias("rb"))
        found = stored(setblocks.reaching(pairs.join(one, "gidx").join(every, "gidy").where("ra <> rb").select("a", "b"), index, blocks, percent))
        if found.isEmpty():
            break
        roots = _merged(roots, found)
    rooted = _rooted(members, roots)
    groups = _spans(rooted)
    pairs = _all_pairs(lists.join(groups, "gid"), percent, hot_from).unionByName(groups.where("lo <> hi").select(F.col("gid").alias("gidx"), F.col("gid").alias("gidy")))
    left, right = (rooted.select(F.col("gid").alias(f"gid{g}"), F.col("cid").alias(c), F.col("root").alias(f"r{c}")) for g, c in ("xa", "yb"))
    pairs = pairs.join(left, "gidx").join(right, "gidy").where("ra <> rb AND (gidx <> gidy OR a < b)").select("a", "b")
    found = setblocks.reaching(pairs, index, blocks, percent)
    #: Rows of one doc_id with different texts join their classes.
    reps = signed.where("rep IS NOT NULL").select("doc_id", "rep")
    twice = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id", "a")
    twice = twice.join(reps, "doc_id").select("a", F.col("rep").alias("b"))
    roots = _merged(roots, found.unionByName(twice).unionByName(named.where("root <> other").select(F.col("root").alias("a"), F.col("other").alias("b"))))

    rows = signed.select("doc_id", "n", "rep").join(roots, F.col("rep") == F.col("node"), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(gid, cid, root) of members (gid, cid)."""
    return stored(members.join(roots, F.col("cid") == F.col("node"), "left").select("gid", "cid", F.coalesce("root", "cid").alias("root")))


def _spans(rooted: DataFrame) -> DataFrame:
    """(gid, lo, hi): the least and largest root of a group's members."""
    return rooted.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))


def deduplicated(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """docs with one document of each component, that with the smallest doc_id.

    Rows that repeat this doc_id leave one, the least by text and the other columns. Rows without an id stay. Null and
    empty texts stay too, an empty table gives no rows, and docs keeps its columns, whatever their names.
    """
    one, row = unused(docs.columns, "one", "row")
    same = F.col("doc_id") == F.col(one)
    gone = stored(joined.where("doc_id <> component_id").select(F.col("doc_id").alias(one)).distinct())
    again = stored(joined.where("doc_id = component_id").groupBy(F.col("doc_id").alias(one)).agg(F.count("*").alias("times")).where("times > 1").select(one))
    kept = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept
    several = kept.join(again, same, "left_semi")
    first = several.groupBy("doc_id").agg(F.min(F.struct("text", *[F.col(f"`{c}`") for c in docs.columns if c != "text"])).alias(row))
    return kept.join(again, same, "left_anti").unionByName(first.select(f"{row}.*").select(*[F.col(f"`{c}`") for c in docs.columns]))
