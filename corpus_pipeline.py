"""The corpus pipeline: language ID, near-duplicates, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, common, langid, mixing, nearcopies, repeats
from quire.llm.queries import tokenizer_path


def _stage(at: int, work):
    """A stage first drops what the one before it staged, whose result is written by then; other queries' tables stay."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if at:
            common.release(spark, f"corpus-stage-{at - 1}")
        common.small_batches(spark)
        with common.owned(f"corpus-stage-{at}"):
            return work(spark, docs, sf_dir)

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no language scores enough."""
    return langid.reject_unknown(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, texts of which 0.8 of the five-word shingles agree."""
    return nearcopies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over 50 words that another text holds too out of every text; n_chars follows the text."""
    cut = repeats.cut_repeats(docs, repeats.WORDS, anchor=repeats.WORD_ANCHOR, words=True, across=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as many times as its source's weight asks for."""
    return mixing.apply_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of what they decode to."""
    rows = bpe.encode(docs, tokenizer_path(), with_text=True)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", _stage(0, language)),
    ("near_duplicates", _stage(1, near_duplicates)),
    ("repeated_passages", _stage(2, repeated_passages)),
    ("mixing", _stage(3, mixture)),
    ("token_ids", _stage(4, token_ids)),
]

#: SQL can't express the learnt model, the suffix arrays or the tokenizer; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the results of all but the last are written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
