"""A corpus from end to end: language, near copies, benchmark passages, mixture, token files.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the next docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, langid, mixing, tokenfiles
from tessera.llm.common import shared_dir, table, unused
from tessera.llm.queries import tokenizer_path

#: Documents whose best language is less likely than this go, as do those without any letter.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language: null texts, texts without a letter, doubtful ones.

    Repeated rows meet the same fate; docs may have any other columns; an empty table gives no rows.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    best, score = unused(docs.columns, "lang_pred", "score")
    known = langid.predict(docs, model, docs.columns, (best, score))
    return known.where((F.col(best) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest doc_id.

    Null and empty texts and rows without an id stay, rows that repeat an id leave one; docs may have any other columns; an
    empty table gives no rows.
    """
    return jaccard.deduplicated(docs, jaccard.join(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage.

    Null and empty texts stay, repeated rows meet the same fate; docs may have any other columns; an empty table gives no rows.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for.

    Null texts have no words, a null source is one of its own; rows that repeat id, source and size share one fate; docs may have any
    other columns; an empty table gives no rows.
    """
    return mixing.mixed(docs, mixing.mix(docs, table(spark, sf_dir, "labels")))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold: doc_id, start, n_tokens, ids_crc32.

    Null texts hold the end id alone, null ids come first, repeated rows are written one by one; other columns are ignored; an
    empty table gives no rows.
    """
    return tokenfiles.read(tokenfiles.write(docs, shared_dir(spark) + "/tokens", tokenizer_path()))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: Hashed classes and a tokenizer: no SQL states them. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
