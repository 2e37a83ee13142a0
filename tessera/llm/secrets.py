"""Secret scans: fixed patterns plus sliding-window entropy over candidate strings, all in SQL functions.

Matches are found by ``regexp_extract_all`` and placed by the lengths of the pieces that ``split``
leaves between them, so a match's offset needs no row-at-a-time code. Candidates for the entropy scan
are unbroken runs of key-like characters. A window slides over a candidate; counts per character class
are kept incrementally (one symbol enters, one leaves) together with the sum of c*log2(c), which
gives the window's Shannon entropy in work that depends on the window's length alone. Candidates that an allow list explains
(words, paths, ids with structure) are suppressed.
"""

from __future__ import annotations

from functools import cache, reduce
from math import comb, log2, sqrt
from operator import or_
from string import ascii_lowercase as LOWER
from string import ascii_uppercase as UPPER
from string import digits as DIGITS

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in their order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Symbols of each class; least_entropy() says from where on a window of them counts as random.
CLASSES = {
    "hex": DIGITS + "abcdef",
    "base": UPPER + LOWER + DIGITS + "+/_=-",
    "upper_hex": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "lower_base32": LOWER + "234567",
    "base36": LOWER + DIGITS,
    "upper_base36": UPPER + DIGITS,
    "base62": UPPER + LOWER + DIGITS,
}

#: Whole candidates that are no secrets: ids in fixed groups, runs of words, paths, one repeated symbol, placeholders.
ALLOW = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[A-Za-z]+",
    r"[/_=-]*WORD(?:[/_=-]+WORD)++[/_=-]*".replace("WORD", r"(?:(?:[A-Z]?[a-z]+)++[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,4})"),
    r"[0-9+/_=-]+",
    r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})?(?:[/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*+[/_=-]*",
    r".*(?:EXAMPLE|example|XXXX|xxxx|0000).*",
)


@cache
def least_entropy(symbols: int, window: int = 20) -> float:
    """Expected entropy of a window of random symbols of a class of this size, less three standard deviations.

    About 995 of 1,000 random windows reach it. Counts of symbols are multinomial; both moments of the sum of c*log2(c) are exact.
    """
    p, term = 1 / symbols, lambda c: c * log2(c) if c else 0.0
    one = [comb(window, c) * p**c * (1 - p) ** (window - c) for c in range(window + 1)]
    first, second = (sum(x * term(c) ** k for c, x in enumerate(one)) for k in (1, 2))
    cross = sum(comb(window, c) * comb(window - c, d) * p ** (c + d) * (1 - 2 * p) ** (window - c - d) * term(c) * term(d) for c in range(window + 1) for d in range(window - c + 1))
    variance = symbols * second + symbols * (symbols - 1) * cross - (symbols * first) ** 2
    return log2(window) - (symbols * first + 3 * sqrt(max(variance, 0.0))) / window


def _with(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, block: int = 128) -> Column:
    """Sums of an array's elements before each one, in steps of blocks: n * block + (n / block)^2 / 2 additions, no copies."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    count = lambda xs: F.greatest(F.lit(1), F.ceil(F.size(xs) / block).cast("int"))
    sums = lambda xs: F.transform(F.sequence(F.lit(0), count(xs) - 1), lambda k: add(F.slice(xs, k * block + 1, block)))
    firsts = lambda own: F.transform(own, lambda _, k: add(F.slice(own, 1, k)))
    whole = lambda xs, first: F.transform(xs, lambda _, i: F.get(first, F.floor(i / block).cast("int")) + add(F.slice(xs, i - i % block + 1, i % block)))
    return _with(numbers, lambda xs: _with(_with(sums(xs), firsts), lambda first: whole(xs, first)))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches, in code points."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def place(m: Column, gaps: Column) -> Column:
        start = lambda before, i: F.get(before, i) + F.get(gaps, i)
        span = lambda before, s, i: F.struct(start(before, i).alias("start"), (start(before, i) + F.length(s)).alias("end"), s.alias("match"))
        used = F.transform(m, lambda s, i: F.length(s) + F.get(gaps, i))
        return _with(running(used), lambda before: F.transform(m, lambda s, i: span(before, s, i)))

    def placed(m: Column) -> Column:
        return _with(F.transform(F.split(text, pattern), lambda g: F.length(g)), lambda gaps: place(m, gaps))

    return _with(whole, lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m)))


def overlaps(x: Column, spans: Column, halvings: int = 31) -> Column:
    """Whether x touches one of the sorted, disjoint spans: binary search for the last that begins before x ends."""
    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    middle = lambda acc: F.shiftright(acc["lo"] + acc["hi"], 1)
    down = lambda acc: F.struct(acc["lo"].alias("lo"), middle(acc).alias("hi"))
    up = lambda acc: F.struct((middle(acc) + 1).alias("lo"), acc["hi"].alias("hi"))
    step = lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.when(F.get(spans, middle(acc))["start"] < x["end"], up(acc)).otherwise(down(acc)))
    steps = F.sequence(F.lit(0), F.least(F.lit(halvings), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int")))
    before = F.aggregate(steps, start, step, lambda acc: acc["lo"])
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(_with(before, lambda k: F.coalesce(F.get(spans, k - 1)["end"] > x["start"], F.lit(False))))


def window_entropy(string: Column, symbols: str, window: int = 20) -> Column:
    """Largest Shannon entropy (bits a symbol) of a window of ``window`` symbols of the class; 0 if none fits.

    A symbol outside the class empties the window. Counts of the window's symbols are carried from step to step, packed into longs,
    with the sum of c*log2(c): one symbol leaves, one enters, and only their two counts are read and changed.
    """
    bits = window.bit_length()
    held = 63 // bits  # counts a long
    terms = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(window + 1)])
    codes = F.transform(F.split(string, ""), lambda ch: F.when(ch == "", F.lit(-1)).otherwise(F.instr(F.lit(symbols), ch) - 1))
    none = F.array(*[F.lit(0).cast("long")] * -(-len(symbols) // held))
    units = F.array(*[F.lit(1 << bits * k) for k in range(held)])
    cell = lambda k: F.floor(k / held).cast("int")
    unit = lambda k: F.get(units, k % held)

    def state(n: Column, s: Column, best: Column, counts: Column) -> Column:
        return F.struct(n.cast("int").alias("n"), s.alias("s"), best.alias("best"), counts.alias("counts"))

    def changed(counts: Column, k: Column, by: int) -> Column:
        return F.transform(counts, lambda packed, at: F.when(at == cell(k), packed + by * unit(k)).otherwise(packed))

    def count(counts: Column, k: Column) -> Column:
        low = F.call_function("shiftright", F.get(counts, cell(k)), (k % held * bits).cast("int"))
        return low.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")

    def entered(acc: Column, k: Column) -> Column:
        """With k as one more symbol of the window."""
        def one(c: Column) -> Column:
            s = acc["s"] + F.get(terms, c + 1) - F.get(terms, c)
            full = F.when(acc["n"] + 1 == window, F.lit(log2(window)) - s / window).otherwise(F.lit(0.0))
            return state(acc["n"] + 1, s, F.greatest(acc["best"], full), changed(acc["counts"], k, 1))

        return _with(count(acc["counts"], k), one)

    def left(acc: Column, k: Column) -> Column:
        """A full window without its first symbol k."""
        one = lambda c: state(acc["n"] - 1, acc["s"] - F.get(terms, c) + F.get(terms, c - 1), acc["best"], changed(acc["counts"], k, -1))
        return F.when(acc["n"] < window, acc).otherwise(_with(count(acc["counts"], k), one))

    def run(code: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            with_k = _with(left(acc, F.get(code, i - window)), lambda a: entered(a, F.get(code, i)))
            return F.when(F.get(code, i) >= 0, with_k).otherwise(state(F.lit(0), F.lit(0.0), acc["best"], none))

        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), state(F.lit(0), F.lit(0.0), F.lit(0.0), none), step, lambda acc: acc["best"])

    return F.when(F.length(string) < window, F.lit(0.0)).otherwise(_with(codes, run))


def random_string(string: Column, window: int = 20) -> Column:
    """Whether some window of a candidate is random in its class, and nothing on the allow list explains it."""
    allowed = string.rlike("^(?:" + "|".join(f"(?:{a})" for a in ALLOW) + ")$") | string.rlike(r"^(.)\1*$")
    tests = [F.when(string.rlike(f"[{symbols.replace('-', '')}-]{{{window}}}"), window_entropy(string, symbols, window) >= least_entropy(len(symbols), window)).otherwise(F.lit(False)) for symbols in CLASSES.values()]
    return ~allowed & reduce(or_, tests)


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text, base (array of kind, start, end), added (likewise).

    A null text is an empty one. Added spans are entropy hits that overlap no base span. Long texts are scanned whole,
    spans that begin at one place are ordered by kind, repeated rows are scanned one by one, empty tables give no rows, other
    columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    long_value = lambda x: F.length(F.regexp_extract(x["match"], f"^{ASSIGN}$", 1)) >= 6
    found = {"assign": F.filter(located(F.col("text"), ASSIGN), long_value), "access": located(F.col("text"), ACCESS), "hex": located(F.col("text"), HEX)}
    rows = rows.select("doc_id", "text", *[spans.alias(kind) for kind, spans in found.items()])
    apart = lambda x: ~reduce(or_, [overlaps(x, F.col(kind)) for kind in found])
    odd = F.filter(F.filter(located(F.col("text"), CANDIDATE), apart), lambda x: random_string(x["match"], window))
    base = F.concat(*[_of_kind(F.col(kind), k) for k, kind in enumerate(found)])
    return rows.select("doc_id", "text", base.alias("base"), _of_kind(odd, 3).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, per row of docs, which scan() reads; nulls and the rest as there."""
    rows = scan(docs, window=window)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, *, window: int = 20, mask: str = "[secret]") -> DataFrame:
    """doc_id and the text with every span, base or added, replaced by ``mask``; overlapping spans give one mask each where they begin outside the one before.

    Nulls become empty texts; repeated rows, empty tables and other columns are as in scan().
    """
    rows = scan(docs, window=window).withColumn("spans", F.sort_array(F.concat("base", "added")))
    step = lambda acc, x: F.when(x["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))).otherwise(F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask)).alias("out"), x["end"].alias("at")))
    done = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rows.select("doc_id", done.alias("text"))
