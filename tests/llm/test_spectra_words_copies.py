"""Whitening, spelling variants and exact duplicates against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exactdedup, perfecthash, spelling, whitening
from tests.llm.test_operators import ODD, docs

VECTOR = "vec_id long, embedding array<float>, label int, x string, n long, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], VECTOR)


def brute_white(rows, k=8):
    """Vectors that remain, the matrix of longs, eigenvalues and eigenvectors."""
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    x = np.array([np.floor(1024 * v) + 100000 for _, v in kept]).astype(np.int64)
    c = x - x.mean(axis=0)
    w, e = np.linalg.eigh(c.T @ c / len(x))
    return [i for i, _ in kept], x, w[::-1], e[:, ::-1], c


@pytest.mark.parametrize(("n", "d", "flat"), [(60, 12, True), (300, 6, False), (7, 20, False)])
def test_whitening_equals_a_dense_decomposition(spark, n, d, flat):
    rng = np.random.default_rng(n)
    scale = np.ones(d) if flat else 2.0 ** -np.arange(d)
    rows = [(i, (rng.standard_normal(d) * scale).tolist()) for i in range(n)]
    bad = [(900, None), (901, [None] + [0.0] * (d - 1)), (902, [float("nan")] * d), (903, [float("inf")] + [0.0] * (d - 1))]
    again = [(3, rows[3][1]), (None, rows[4][1])]
    out = whitening.report(vectors(spark, rows + bad + again)).toPandas()
    ids, x, w, e, c = brute_white(rows + again)
    k = min(8, d, len(np.unique(x, axis=0)) - 1)
    assert sorted(out["component"].unique()) == list(range(1, k + 1)) and len(out) == k * (n + 2)
    assert out["vec_id"].isna().sum() == k and set(out["vec_id"].dropna()) == set(range(n)) and (out["n"] == n + 2).all()
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    deviation = ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert sorted(out["deviation"][out["component"] == 1]) == sorted(deviation)
    for j in range(1, k + 1):
        own = out[out["component"] == j]
        assert np.allclose(own["explained"], w[j - 1] / w.sum(), rtol=1e-10)
        got = dict(zip(own["vec_id"].fillna(-1), own["whitened"], strict=True))
        want = {-1 if i is None else i: v for i, v in zip(ids, c @ e[:, j - 1] / np.sqrt(w[j - 1]), strict=True)}
        sign = np.sign(sum(got[i] * want[i] for i in want))
        assert np.allclose([got[i] for i in want], [sign * want[i] for i in want], atol=1e-8)


def test_whitening_of_tables_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.report(vectors(spark, rows))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.report(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [1.0]), (4, [])])).toPandas()
    assert sorted(one["vec_id"]) == [1, 2] and np.allclose(sorted(one["whitened"]), [-1, 1]) and np.allclose(one["explained"], 1)


def test_whitening_with_equal_eigenvalues(spark):
    """A cube's corners: all directions alike, so one step exhausts what the first vector reaches."""
    rows = [(k, [float(k >> b & 1) for b in range(4)]) for k in range(16)]
    out = whitening.report(vectors(spark, rows)).toPandas()
    assert sorted(out["component"].unique()) == [1, 2, 3, 4] and np.allclose(out["explained"], 0.25) and out["identity_error"].iloc[0] < 1e-9


def test_deviations_are_exact_or_refused():
    x = np.array([[1 << 40, 3]])
    with pytest.raises(OverflowError):
        whitening.deviations(x, 3, np.array([2, 5]))
    small = np.array([[1 << 29, 3]])
    assert whitening.deviations(small, 3, np.array([2, 5])).tolist() == [(3 * (1 << 29) - 2) ** 2 + 16]


def brute_words(rows, every=199, least=5):
    count = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, every=199):
    count = brute_words(rows, every)
    form = {}
    out = {}
    for w, n in count.items():
        beside = [v for v in count if v != w and near(v, w)]
        best = min(beside, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 5 * n else None
        out[w] = (n, len(beside))

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, k, count[form[w]] if form[w] else None) for w, (n, k) in out.items())


@pytest.mark.parametrize("every", [199, 3])
def test_spelling_variants(spark, every):
    rng = np.random.default_rng(every)
    rows = list(ODD)
    bases = ["letter", "lettter", "letttter", "banana", "bananas", "Élèves", "éLÈVEs", "straße", "a×b÷cde", "street", "streets", "strret", "zzzzzzz", "zzzzzz"]
    for i in range(40):
        text = []
        for w in bases:
            text += [w] * int(rng.integers(0, 4))
            edit, at = list(w), int(rng.integers(0, len(w)))
            edit[at : at + 1] = {0: [], 1: ["q"], 2: [w[at], "q"], 3: [w[at]]}[int(rng.integers(0, 4))]
            text.append("".join(edit).upper() if rng.random() < 0.3 else "".join(edit))
        rows.append((100 + i, " ".join(text) + " letter," * 30 + "42street7", "a"))
    rows.append((None, "street " * 2000 + "letter\nletter", None))
    given = docs(spark, rows)
    got = sorted(tuple(r) for r in spelling.variants(given, every=every).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = brute_variants(rows, every)
    assert got == want and any(r[1] for r in want)
    assert spelling.variants(given.limit(0)).count() == 0


def test_chains_of_forms_reach_their_end(spark):
    words = [f"word{k:02d}x" for k in range(9)]
    forms = spark.createDataFrame([(a, b) for a, b in zip(words, words[1:], strict=False)] + [("beside", words[3])], "word string, form string")
    for most in (100, 0):
        assert {r.word: r.root for r in spelling.roots(forms, most).collect()} == {w: words[-1] for w in [*words[:-1], "beside"]}


def test_perfect_hash_is_minimal_and_keeps_strangers_out():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
    for most in (40, 2):
        made = perfecthash.PerfectHash.loads(perfecthash.PerfectHash.of(keys, most=most).dumps())
        assert sorted(made.slots(keys)) == list(range(5000)) and len(made) == 5000
        strange = made.slots(rng.integers(0, 1 << 63, (3000, 4)).astype(np.uint64))
        assert strange.min() >= -1 and strange.max() < 5000
    none = perfecthash.PerfectHash.of(keys[:0])
    assert len(none) == 0 and none.slots(keys[:3]).tolist() == [-1] * 3


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = [i == keep for i in ids]
        first = kept.index(True)
        out += [(i, keep, len(ids), k == first, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("per_bucket", "most"), [(2000, 200_000), (3, 2)])
def test_exact_dedup(spark, per_bucket, most):
    rng = np.random.default_rng(1)
    texts = [f"text {k} É" for k in range(60)]
    rows = [*ODD, (None, None, None), (None, "only nulls", "a"), (None, "only nulls", "a"), (77, "long " * 60_000, "a"), (20, "long " * 60_000, "b"), (21, "long " * 60_000 + ".", "b")]
    rows += [(200 + i, texts[int(rng.integers(0, 60) ** 2 / 60)], "c") for i in range(300)] + [(1000 + i, "the hot text", "d") for i in range(150)]
    given = docs(spark, rows).withColumn("old", F.lit("o")).withColumn("digest", F.lit("d"))
    want = brute_copies(rows)
    by = [None, F.lit(False), F.lit(True), F.pmod(F.xxhash64("doc_id", "source"), F.lit(2)) == 0]
    for old in by if per_bucket == 3 else by[:1]:
        out = exactdedup.dedup(given, old, per_bucket=per_bucket, most=most)
        assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert exactdedup.dedup(given.limit(0)).count() == 0


def test_batches_admitted_one_after_the_other(spark):
    """Three batches against a growing index give the groups of all rows at once."""
    rows = spark.range(900).select(exactdedup.digest((F.col("id") * 7 % 250).cast("string")).alias("digest"), F.col("id").alias("doc_id"), F.col("id").alias("row"), F.lit(1).cast("long").alias("n"))
    held = rows.where("doc_id < 100")
    held = exactdedup.groups(held)
    for a, b in ((100, 500), (500, 900)):
        held = exactdedup.merged(exactdedup.build(held, 4), rows.where(f"doc_id >= {a} AND doc_id < {b}"), 4)
    line = lambda r: (bytes(r.digest), r.doc_id, r.row, r.n)
    assert sorted(map(line, held.collect())) == sorted(map(line, exactdedup.groups(rows).collect()))
