"""Quality rules as a short-circuit cascade.

The base figures of a document are computed once. The rules read them and a few more expressions;
a sample gives each rule's cost (measured seconds) and selectivity (share it rejects), and the rules
run in order of rejection per cost inside one CASE, which stops at the first rule that rejects. The
order changes the time and the named reason, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, space_words

WINDOW = 8
#: A line that begins with a bullet, a line that ends in an ellipsis; lines end at \\n alone.
BULLET = r"(?:^|\n)[\x20\t]*[-*•]\x20"
ELLIPSIS = r"(?:\.\.\.|…)[\x20\t\r]*(?:\n|\z)"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of ``size`` words that occur at least twice in the array.

    Windows are compared by a 64-bit hash. Only arrays with a repeated hash are sorted.
    """
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _with(F.sort_array(_with(pairs, _repeated)), lambda starts: _covered_by(starts, size))

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
        some = _with(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        return F.when(F.size(w) < size + 1, F.lit(0)).otherwise(some).cast("long")

    return _with(words, counted)


def _repeated(pairs: Column) -> Column:
    """Positions whose hash a neighbour in the sorted (hash, position) pairs shares."""
    same = lambda k, x: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
    marked = F.transform(pairs, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"]))
    return F.filter(marked, lambda i: i.isNotNull())


def _covered_by(starts: Column, size: int) -> Column:
    """Length of the union of the spans of ``size`` words that begin at the sorted starts."""
    gains = F.transform(starts, lambda at, k: F.least(F.lit(size), F.coalesce(F.get(starts, k + 1) - at, F.lit(size))))
    return F.aggregate(gains, F.lit(0), lambda total, x: total + x)


def _with(value: Column, body) -> Column:
    """body(value) with value computed once, however often the optimiser copies the expression into others:
    a lambda variable is bound to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, text, lines_n, one row per row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    rows = docs.select("doc_id", text.alias("text"), space_words(F.col("text")).alias("words"), lines.alias("lines"))
    return rows.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def most_common(words: Column) -> Column:
    """How often the commonest word of an array occurs in it."""
    def longest(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
        return _with(starts, lambda at: F.array_max(F.transform(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(w)) - i)))

    return F.coalesce(_with(F.sort_array(words), longest), F.lit(0)).cast("long")


def default_rules(
    max_symbol_ratio: float = 0.3,
    min_word: float = 1.5,
    max_word: float = 25.0,
    max_dup_lines: float = 0.5,
    min_letters: float = 0.4,
    min_letter_words: float = 0.5,
    max_common: float = 0.3,
    max_bullets: float = 0.9,
    max_ellipses: float = 0.5,
    some_lines: int = 3,
) -> list[Rule]:
    """Rules over base_figures(): mean word length, symbols per word, repeated lines, letters per character, words with a letter,
    share of the commonest word, and in texts of some_lines lines or more those that begin with a bullet or end in an ellipsis.

    The first three compare ready figures, the others read the text or its words again, so they are what the order saves.
    """
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    words = space_words(F.col("text"))
    with_letter = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    lines = lambda pattern, most: (F.col("n_lines") >= some_lines) & (F.regexp_count("text", F.lit(pattern)) > most * F.col("n_lines"))
    return [
        Rule("word_length", (mean < min_word) | (mean > max_word)),
        Rule("symbols", F.col("n_symbols") > max_symbol_ratio * F.col("n_words")),
        Rule("repeated_lines", F.col("n_dup_lines") > max_dup_lines * F.col("n_lines")),
        Rule("letters", letters < min_letters * F.col("word_chars")),
        Rule("letter_words", with_letter < min_letter_words * F.col("n_words")),
        Rule("common_word", most_common(words) > max_common * F.col("n_words")),
        Rule("bullets", lines(BULLET, max_bullets)),
        Rule("ellipses", lines(ELLIPSIS, max_ellipses)),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 500, times: int = 20) -> list[Rule]:
    """Rules by falling rejection per second, both measured on a sample of about sample_rows rows from all of the table.

    One pass counts what each rule rejects and compiles them all; then every rule is evaluated ``times`` times a row in a pass
    of its own, and the time of a pass without a rule taken off. Ties and rules that reject nothing keep their order by cost.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = base_figures(docs.select("doc_id", "text").sample(share, seed=11)).cache()
    lost = sample.agg(F.count("*"), *[F.count_if(r.rejects) for r in rules]).first()
    many = sample.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def seconds(rejects: Column) -> float:
        began = time.perf_counter()
        many.agg(F.count_if(rejects)).first()
        return time.perf_counter() - began

    nothing = F.col("time") < 0
    seconds(nothing)
    empty = seconds(nothing)
    cost = {r.name: max(seconds(r.rejects) - empty, 1e-6) for r in rules}
    sample.unpersist()
    gain = {r.name: (-(n / max(lost[0], 1)) / cost[r.name], cost[r.name]) for r, n in zip(rules, lost[1:], strict=True)}
    return sorted(rules, key=lambda r: gain[r.name])


def judge(docs: DataFrame, rules: list[Rule] | None = None, *, min_words: int = 20, max_repeat_percent: int = 30, ordered: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): the base figures, base_failed, kept, and reason of a rejection.

    Null and empty texts have no words and fail the base. Long texts are read whole, repeated rows are judged one by one,
    empty tables give no rows, other columns of docs are ignored. Where several rules reject, the first in the measured order is
    the reason; the verdict is the same in any order.
    """
    figures = base_figures(docs)
    rules = default_rules() if rules is None else rules
    if not ordered:
        rules = order_rules(docs, rules)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    reason = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        reason = reason.when(rule.rejects, F.lit(rule.name))
    return figures.withColumn("base_failed", base).withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).drop("text")
