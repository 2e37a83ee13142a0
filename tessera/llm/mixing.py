"""Mixing sources to target weights: Efraimidis-Spirakis sampling with complete epochs first.

Every document draws u from a hash of its id and gets the exponential key -ln(u) / weight. Within a
source the documents are ordered by key and taken until their sizes reach the source's budget. A
budget of several source sizes first takes every document that many times (complete epochs); only
the remainder is sampled.

No source is ever sorted in one task. Keys map monotonically to [0, 1), which is cut into buckets of
about ``bucket_rows`` documents, at edges that follow the documents' weights; prefix sums over bucket totals find the one bucket of each source in
which the budget ends, and only that bucket's documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, repeated, stored, unused


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5, the same in every run and engine."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, max_epochs: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row a source.

    Sources sorted by code point, null last, weigh ``cycle`` in turn and share the total size. A target
    stops at max_epochs times its source's size and the excess goes to the others by weight, until none
    is above: sources in order of cap / weight are full as long as their fair share of what is left
    exceeds their cap. Sources without words get 0. The windows see one row a source.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.row_number().over(by_name) - 1) % len(cycle) + 1)
    filling = W.orderBy("fill", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    onward = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    everywhere = W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everywhere).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("left", left)
        .withColumn("left_weight", F.sum("weight").over(onward))
        .withColumn("full", F.col("left") * F.col("weight") / F.col("left_weight") >= F.col("cap"))
        .withColumn("first_open", F.max(F.when(~F.col("full"), F.struct(-F.col("fill"), F.col("left") / F.col("left_weight")))).over(everywhere)["col2"])
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("first_open") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, labels: DataFrame | None = None, *, seed: int = 17, max_epochs: float = 3.0, bucket_rows: int = 4000, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """One row per distinct (doc_id, source, size): these, copies, source_size, target, times.

    docs: doc_id, text, source. labels: doc_id, quality (1 good, 0 bad; unlabelled and null weigh 1,
    the best label of a repeated id counts). ``times`` is how often the mix takes each of the ``copies``
    rows. Null texts have size 0, a null source is a source of its own, a null doc_id draws like any
    other id. Rows that repeat an id, source and size share one key and one fate. Documents without
    words come along in complete epochs and where they lie before the cut. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    if labels is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        rows = rows.join(best, "doc_id", "left").withColumn("weight", F.when(F.col("quality") == 1, good).when(F.col("quality") == 0, bad).otherwise(F.lit(1.0)))
    #: 1 - u^(1/weight) = 1 - exp(-key) rises with the exponential key and stays in [0, 1).
    rank = -F.expm1(F.log(uniform(F.col("doc_id"), seed)) / F.col("weight"))
    words = F.col("size") * F.col("copies")
    rows = stored(rows.select("doc_id", "source", "size", "copies", "weight", words.alias("words"), rank.alias("rank")))

    of = lambda w: F.count(F.when(F.col("weight") == w, 1))
    totals = rows.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("n"), of(good).alias("n_good"), of(bad).alias("n_bad"))
    same = F.col("source").eqNullSafe(F.col("s"))
    sources = source_targets(totals.select("source", "source_size"), max_epochs).join(totals.select(F.col("source").alias("s"), "n", "n_good", "n_bad"), same).drop("s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("epochs", epochs)
    sources = sources.withColumns({"rest": F.col("target") - F.col("epochs") * F.col("source_size"), "buckets": F.ceil(F.col("n") / bucket_rows)})
    sources = stored(sources)

    keyed = rows.join(sources.withColumnRenamed("source", "s"), same).drop("s")
    #: The share of a source's documents that are expected before a rank, by its weights: it rises with the rank, and buckets get even rows.
    upto_rank = lambda w: 1 - F.pow(1 - F.col("rank"), F.lit(float(w)))
    share = (F.col("n_good") * upto_rank(good) + F.col("n_bad") * upto_rank(bad) + (F.col("n") - F.col("n_good") - F.col("n_bad")) * F.col("rank")) / F.col("n")
    if good == bad:
        share = upto_rank(good)
    keyed = keyed.withColumn("bucket", F.least(F.floor(share * F.col("buckets")), F.col("buckets") - 1).cast("long")).drop("n", "n_good", "n_bad")
    filled = keyed.groupBy("source", "bucket").agg(F.sum("words").alias("bucket_words"), F.max("rest").alias("rest"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    filled = filled.withColumn("before", F.coalesce(F.sum("bucket_words").over(upto), F.lit(0)))
    #: The last bucket that the remainder reaches.
    cut = filled.where(F.col("before") < F.col("rest")).groupBy("source").agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("cut"))
    cut = cut.select(F.col("source").alias("s"), F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("cut_before"))
    keyed = keyed.join(cut, same, "left").drop("s")

    inside = keyed.where(F.col("bucket") == F.col("cut_bucket"))
    order = W.partitionBy("source", "bucket").orderBy("rank", F.col("doc_id").isNull(), "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("cut_before") + F.sum("words").over(order) - F.col("words") / 2
    inside = inside.withColumn("picked", middle <= F.col("rest"))
    outside = keyed.where(F.col("cut_bucket").isNull() | (F.col("bucket") != F.col("cut_bucket")))
    outside = outside.withColumn("picked", F.coalesce(F.col("bucket") < F.col("cut_bucket"), F.lit(False)))
    both = inside.unionByName(outside)
    return both.select("doc_id", "source", "size", "copies", "source_size", "target", (F.col("epochs") + F.col("picked").cast("long")).alias("times"))


def mixed(docs: DataFrame, mixture: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mixture takes it, in docs' own columns, whatever their names.

    docs is the table that the mixture was made of: nulls and repeated rows meet the fate that mix() gives them.
    """
    names = unused(docs.columns, "id", "of", "words", "times")
    key = mixture.where("times > 0").select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "source", "size", "times"), names, strict=True)])
    same = F.col("doc_id").eqNullSafe(F.col(names[0])) & F.col("source").eqNullSafe(F.col(names[1])) & (word_count(F.col("text")) == F.col(names[2]))
    return repeated(docs.join(key, same), F.col(names[3])).select(*[F.col(f"`{c}`") for c in docs.columns])
