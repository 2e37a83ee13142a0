"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language inside Spark tasks (numpy bincount, then a grouped sum);
the log-probability matrix, ``buckets`` x languages, is broadcast. Scoring runs over Arrow batches:
the texts of a batch are laid end to end, the n-grams of a slice are hashed at once, and their matrix rows, of which
a text touches few, are summed text by text in one reduction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, give_back, small_batches, tidy, unused

#: Odd multipliers of the n-gram hash, by position; and code points scored at once.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
SLICE = 1 << 17


@dataclass(frozen=True)
class Model:
    """langs: sorted labels; weights: float32 [len(langs), buckets]; prior: log prior by language."""

    langs: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray
    sizes: tuple[int, ...]

    @cached_property
    def rows(self) -> np.ndarray:
        """[buckets + 1, len(langs)]: a row a bucket, and one of zeros for n-grams that reach over a text's end."""
        return np.ascontiguousarray(np.vstack([self.weights.T, np.zeros((1, len(self.langs)), np.float32)]))


def gram_ids(codes: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point (len(codes) - n + 1 of them)."""
    if len(codes) < n:
        return np.empty(0, np.int64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h += codes[k : len(codes) - n + 1 + k] * np.uint64(FACTORS[k])
        h ^= h >> np.uint64(29)
    h *= np.uint64(FACTORS[n % 4])
    return (h >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    """Lower-case code points between two spaces."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def batch_scores(texts: list[str], model: Model) -> np.ndarray:
    """[len(texts), languages]: log joints, summed in slices of code points so that memory doesn't follow the texts' length."""
    padded = [f" {t.lower()} " for t in texts]
    edges = np.cumsum([0, *map(len, padded)])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    total, none = np.tile(model.prior.astype(np.float64), (len(texts), 1)), model.weights.shape[1]
    for n in model.sizes:
        for at in range(0, len(codes) - n + 1, SLICE):
            ids = gram_ids(codes[at : at + SLICE + n - 1].astype(np.uint64), n, none)
            lo, hi = np.searchsorted(edges, [at, at + len(ids) - 1], side="right") - 1
            over = (edges[lo + 1 : hi + 2, None] - np.arange(1, n) - at).ravel()
            ids[over[(over >= 0) & (over < len(ids))]] = none
            total[lo : hi + 1] += np.add.reduceat(model.rows[ids], np.maximum(edges[lo : hi + 1] - at, 0), axis=0, dtype=np.float64)
    return total


def text_scores(text: str, model: Model) -> np.ndarray:
    """Log joint by language."""
    return batch_scores([text], model)[0]


def train(docs: DataFrame, *, max_docs: int = 20000, buckets: int = 1 << 16, sizes: tuple[int, ...] = (2, 3), smooth: float = 0.5, max_langs: int = 1000) -> Model:
    """Fits on at most about max_docs rows of docs (text, lang), chosen by a hash of the text.

    Rows whose text or lang is null don't count; repeated rows count each time; other columns are ignored; an empty
    table gives a model without languages. The result is the same in every run. The matrix is languages x buckets: more
    than max_langs labels in the sample are an error.
    """
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    share = max_docs / max(1, named.count())
    if share < 1:
        named = named.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    named = small_batches(named)
    if not bounded(named.select("lang").distinct(), max_langs):
        raise ValueError(f"more than {max_langs} labels")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                own = sums.setdefault(lang, np.zeros(buckets + 1, np.int64))
                own[buckets] += 1
                codes = code_points(text)
                for n in sizes:
                    own[:buckets] += np.bincount(gram_ids(codes, n, buckets), minlength=buckets)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})

    # Bounded: one row a language and bucket.
    found = named.mapInPandas(tidy(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(found["lang"].unique()))
    counts = np.zeros((len(langs), buckets + 1))
    counts[[langs.index(x) for x in found["lang"]], found["bucket"].to_numpy(int)] = found["n"]
    grams, docs_of = counts[:, :buckets] + smooth, counts[:, buckets]
    weights = np.log(grams / grams.sum(axis=1, keepdims=True))
    return Model(langs, weights.astype(np.float32), np.log((docs_of + 1) / (docs_of.sum() + len(langs))) if langs else docs_of, sizes)


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score, the posterior of that language, under the given names.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if the model
    has no language. Only the text, and all of it, is read for a prediction. Empty tables give no rows; repeated rows
    are scored alike; ties go to the first language in order. ``keep`` may hold any other names.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in parts:
            best, sure = np.full(len(part), "und", object), np.zeros(len(part))
            at = np.flatnonzero([bool(m.langs) and t is not None and has_letter(t) for t in part])
            if len(at):
                s = batch_scores(part.iloc[at].tolist(), m)
                k = s.argmax(axis=1)
                best[at] = np.array(m.langs, object)[k]
                sure[at] = 1 / np.exp(s - s[np.arange(len(at)), k][:, None]).sum(axis=1)
            yield pd.DataFrame({"lang_pred": best, "score": sure})
        give_back()

    guess = F.pandas_udf(score, "lang_pred string, score double")(F.col("text"))
    (made,) = unused([*keep, *names], "guess")
    kept = [F.col(f"`{c}`") for c in keep]
    return docs.select(*kept, guess.alias(made)).select(*kept, F.col(f"{made}.lang_pred").alias(names[0]), F.col(f"{made}.score").alias(names[1]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id, as text, leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
