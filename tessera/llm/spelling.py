"""Spelling variants of a corpus's words by permuterm rotations.

A word with a terminator behind it has one rotation a position. Two words that differ by one replaced, inserted or
deleted code point share a rotation but for the code point at its end, so all of them are neighbours under one prefix. Every
rotation goes under two prefixes: itself, as the word that lacks a code point there, and itself without its last code point, as a
word that has one. Rotations are sorted by prefix and each prefix is scanned once: it holds at most one word of
the first kind, and of the second kind one word a code point of the alphabet. A scan returns one line a word (how many
neighbours, and the best of them), never the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, bounded, stored

#: Letters of a run, as a character class body.
LETTERS = r"A-Za-zÀ-ÿ"
#: Sorts after every letter below U+0100 and stands in no word.
END = "Ā"


def deleted(word: Column, doc_id: Column, every: int) -> Column:
    """The word, without its code point h % length where ``every`` divides h, the crc32 of ``doc_id:word``; a null id counts as empty."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word), "UTF-8"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def words(docs: DataFrame, *, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) with ``shortest`` code points and ``least`` occurrences, or more.

    Words are whole runs of letters, A-Z in lower case; one in about ``every`` loses a code point by its checksum (see ``deleted``).
    Null texts have none. Runs that are too short never leave their text; counts are added up in tasks first.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    low = runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    counted = low.select(deleted(F.col("run"), F.col("doc_id"), every).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= shortest) & (F.col("n") >= least))


def prefixes(words_: DataFrame) -> DataFrame:
    """(prefix, has, inner, word, n): every rotation of every word under both of its prefixes.

    ``has``: the word has a code point behind the prefix. ``inner`` marks those prefixes of equal code points in a row that
    count for inserted and deleted ones: only the first, since deleting either of them gives the same word.
    """
    at = F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at")
    rows = words_.select("word", "n", F.length("word").alias("size"), at)
    head, tail = F.substring("word", F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 1, F.col("size"))
    lacks = rows.select(F.concat(tail, F.lit(END), head).alias("prefix"), F.lit(False).alias("has"), F.lit(True).alias("inner"), "word", "n")
    after, first = F.substring(F.col("word"), F.col("at") + 2, F.col("size")), F.substring(F.col("word"), F.col("at") + 1, F.lit(1))
    inner = (F.col("at") == 0) | (F.substring(F.col("word"), F.col("at"), F.lit(1)) != first)
    has = rows.where(F.col("at") < F.col("size")).select(F.concat(after, F.lit(END), head).alias("prefix"), F.lit(True).alias("has"), inner.alias("inner"), "word", "n")
    return lacks.unionByName(has)


def better(n: Column, word: Column) -> Column:
    """A struct whose largest value is that of the largest n, then of the smallest word."""
    return F.struct((-n).alias("n"), word.alias("word"))


def neighbours(words_: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are near each word that has any, and the best of them as (-n, word).

    Each near pair meets under exactly one prefix: two words of one length under that of the code point in which they differ, a word and
    a longer one under that of the first of equal code points. Rows under a prefix are at most the letters of the alphabet
    and one, so sorted prefixes are scanned by windows of bounded size; lines of one prefix alone go before that.
    """
    rows = prefixes(words_)
    scan = W.partitionBy("prefix")
    order = F.struct((-F.col("n")).alias("n"), "word")
    seen = rows.select(
        "prefix", "word", "has", "inner", order.alias("own"),
        F.count(F.when(F.col("has"), 1)).over(scan).alias("n_has"), F.count(F.when(F.col("has") & F.col("inner"), 1)).over(scan).alias("n_inner"), F.count(F.when(~F.col("has"), 1)).over(scan).alias("n_lacks"),
        F.min(F.when(~F.col("has"), order)).over(scan).alias("lack"),
        F.min(F.when(F.col("has") & F.col("inner"), order)).over(scan).alias("best_inner"),
        F.sort_array(F.collect_list(F.when(F.col("has"), order)).over(scan)).alias("all"),
    )
    has, inner = F.col("has"), F.col("inner")
    #: The best of the others that have a code point there: the first in order, or the second for the first itself.
    rival = F.when(F.get("all", F.lit(0)) == F.col("own"), F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0)))
    near = F.when(has, F.col("n_has") - 1 + F.when(inner, F.col("n_lacks")).otherwise(0)).otherwise(F.col("n_inner"))
    best = F.when(has & inner, F.least(rival, F.col("lack"))).when(has, rival).otherwise(F.col("best_inner"))
    lines = seen.select("word", near.alias("near"), best.alias("best")).where("near > 0")
    return lines.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, most: int = 200_000) -> DataFrame:
    """(word, root): the last form reached from each word of forms (word, form), by joining the table with itself.

    Each turn doubles the steps; a form's count is a multiple of its word's, so turns are few. Forms of up to ``most`` words
    are broadcast, others joined by shuffling: a form has no more words than it has neighbours.
    """
    small = bounded(forms, most)
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(now.join(F.broadcast(step) if small else step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, *, shortest: int = 6, least: int = 5, every: int = 199, times: int = 5) -> DataFrame:
    """Per word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Words are near if one code point is inserted, deleted or replaced. A word's form is its near word with the largest n (ties: the
    smallest word by code points) if that is ``times`` its own n or more, else null; root follows forms to the last and is the
    word itself where there is none. Null and empty texts have no words; a null id counts as empty; repeated rows count each
    time; long texts are read whole; other columns are ignored; an empty table gives no rows.
    """
    vocabulary = stored(words(docs, shortest=shortest, least=least, every=every))
    near = neighbours(vocabulary)
    best_n = -F.col("best.n")
    is_form = best_n >= times * F.col("n")
    rows = stored(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, best_n).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
