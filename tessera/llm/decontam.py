"""Benchmark decontamination: a broadcast hash set of benchmark n-grams probed by every training window.

Benchmark texts become windows of ``size`` consecutive words (shorter texts are one window). The
distinct windows form a table keyed by a 64-bit hash. Training texts are scanned in one pass: each
word position yields the hash of its window, the hash join probes the set inside the same stage, and
hits are verified word by word. Only hits and one row per document are shuffled.

The set is broadcast if it has at most ``max_broadcast`` windows; beyond that the same join runs
shuffled by window hash, where Spark splits skewed partitions of the training side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, bounded, join_hot, repeated, split_words, stored, unused

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text."""
    return split_words(ascii_lower(text), GAP)


def window_key(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def benchmark_windows(items: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(windows: key, length, window; members: key, window, item_id), both distinct.

    Items with null, empty or wordless texts have no window. Items without an id are one item without a name.
    """
    rows = items.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("length", F.least(F.size("w"), F.lit(size)))
    rows = rows.select("item_id", "length", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at"))
    window = F.slice("w", F.col("at"), F.col("length"))
    key = F.lit(None).cast("long")
    for n in range(1, size + 1):
        key = F.when(F.col("length") == n, window_key(F.col("w"), F.col("at") - 1, n)).otherwise(key)
    members = rows.select(key.alias("key"), "length", F.array_join(window, " ").alias("window"), "item_id").distinct()
    return members.select("key", "length", "window").distinct(), members


def scan(docs: DataFrame, items: DataFrame, *, size: int = 10, max_broadcast: int = 500_000) -> DataFrame:
    """Per row of docs: doc_id, text_key, copies, n_words, hits (sorted array of word spans), item_ids (sorted strings), n_items.

    Rows that repeat both doc_id and text come as one row with their number in ``copies``. Null texts
    have no words. A window of several items counts for each; items without an id count as one that item_ids leaves out.
    Columns other than doc_id and text are ignored.
    """
    windows, members = benchmark_windows(items, size)
    members = stored(members)
    windows = stored(members.select("key", "length", "window").distinct())
    small = bounded(windows, max_broadcast)
    lengths = [r[0] for r in windows.select("length").distinct().orderBy("length").collect()]  # at most ``size`` numbers

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), item_words(F.col("text")).alias("w"))
    fits = lambda n: F.when((F.col("at") >= 0) & (F.col("at") + n <= F.size("w")), window_key(F.col("w"), F.col("at"), n))
    cells = rows.select("doc_id", "text_key", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    if len(lengths) > 1:
        keys = F.explode(F.when(F.col("at") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.array(*[fits(n) for n in lengths])))
    else:
        keys = F.when(F.col("at") < 0, F.lit(0).cast("long"))
        keys = keys.otherwise(fits(lengths[0])) if lengths else keys
    cells = cells.withColumn("key", keys)
    window = F.array_join(F.slice("w", F.col("at") + 1, F.col("length")), " ")
    if small:
        #: Key 0 at position -1 is a mark that every document carries through the same join.
        mark = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("length"), F.lit("").alias("window"))
        hit = cells.join(F.broadcast(windows.unionByName(mark)), "key").where((F.col("at") < 0) | (window == F.col("window")))
        hit = hit.select("doc_id", "text_key", F.size("w").alias("n"), "at", "length", "key", "window")
    else:
        #: Shuffled cells carry their hash alone; hits are verified by the words that their texts have there.
        light = cells.where("at >= 0 AND key IS NOT NULL").select("doc_id", "text_key", "at", "key")
        maybe = light.join(windows.hint("merge"), "key")
        maybe = maybe.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.struct("at", "length", "key", "window").alias("x")).groupBy("d", "k").agg(F.collect_set("x").alias("xs"))
        texts = rows.select("doc_id", "text_key", "w").dropDuplicates(["doc_id", "text_key"])
        near = texts.join(maybe, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("k")))
        true = F.filter("xs", lambda x: F.array_join(F.slice("w", x["at"] + 1, x["length"]), " ") == x["window"])
        hit = near.select("doc_id", "text_key", F.size("w").alias("n"), true.alias("xs")).select("doc_id", "text_key", "n", F.explode("xs").alias("x")).select("doc_id", "text_key", "n", "x.*")
        marks = rows.select("doc_id", "text_key", F.size("w").alias("n"), F.lit(-1).alias("at"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("key"), F.lit("").alias("window"))
        hit = hit.unionByName(marks)

    inside = F.col("at") >= 0
    spans = hit.groupBy("doc_id", "text_key").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count_if(~inside).alias("copies"),
        F.array_sort(F.collect_set(F.when(inside, F.struct("at", (F.col("at") + F.col("length")).alias("end"))))).alias("hits"),
    )
    found = hit.where(inside).select("doc_id", "text_key", "key", "window").distinct()
    owners = members.select("key", "window", F.col("item_id").cast("string").alias("item"))
    both = found.join(F.broadcast(owners), ["key", "window"]) if bounded(members, max_broadcast) else join_hot(stored(found), owners, ["key", "window"], "doc_id")
    found = both.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max(F.col("item").isNull().cast("int")).alias("nameless"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "item_ids", (F.size("item_ids") + F.col("nameless")).cast("long").alias("n_items"))
    both = spans.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").drop("d", "k")
    return both.withColumns({"item_ids": F.coalesce("item_ids", F.array().cast("array<string>")), "n_items": F.coalesce("n_items", F.lit(0).cast("long"))})


def covered(hits: Column) -> Column:
    """Number of words in the union of sorted (at, end) spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], x["end"]).alias("upto"))
    return F.aggregate(hits, start, step, lambda acc: acc["n"].cast("long"))


def report(docs: DataFrame, items: DataFrame, *, size: int = 10, max_broadcast: int = 500_000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Nulls, repeated rows and other columns are as in scan(); long texts are scanned whole; without items, or items with
    words, nothing is hit; an empty table of documents gives no rows.
    """
    rows = scan(docs, items, size=size, max_broadcast=max_broadcast)
    n_hit = covered(F.col("hits"))
    rows = repeated(rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "copies"), F.col("copies"))
    return rows.drop("copies")


def decontaminate(docs: DataFrame, items: DataFrame, *, size: int = 10, remove: str = "documents", min_share: float = 0.0, max_broadcast: int = 500_000) -> DataFrame:
    """docs without what the benchmark holds, in docs' own columns, whatever their names.

    remove="documents" drops rows in which more than min_share of the words are hit; remove="spans"
    cuts the hit words, with the gap behind each, out of the texts and keeps the rows. Null and empty texts stay as they
    are, repeated rows meet the same fate, empty tables give no rows.
    """
    d, k, own = unused(docs.columns, "d", "k", "hits")
    hits = scan(docs, items, size=size, max_broadcast=max_broadcast).where(F.size("hits") > 0)
    hits = hits.where(covered(F.col("hits")) > min_share * F.col("n_words")).select(F.col("doc_id").alias(d), F.col("text_key").alias(k), F.col("hits").alias(own))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(k))
    if remove == "documents":
        #: Texts stay where they are as long as what is dropped can be broadcast.
        hits = stored(hits.select(d, k))
        return docs.join(F.broadcast(hits) if bounded(hits, 200_000) else hits, same, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove: {remove}")
    word, gap = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    head = F.regexp_extract("text", f"^{gap}", 0)
    pieces = F.regexp_extract_all("text", F.lit(f"({word}(?:{gap})?)"), 1)
    kept = F.filter(pieces, lambda p, i: ~F.exists(F.col(own), lambda h: (i >= h["at"]) & (i < h["end"])))
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(F.concat(head, F.array_join(kept, "")))
    joined = docs.join(hits, same, "left").withColumn("text", text)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
