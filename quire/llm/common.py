"""What several operators share: staged tables in the shared folder, Arrow slices and hashes."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.staging import discard, owned, release, shared_dir, small_batches  # noqa: F401
from quire.sources.staging import written as staged  # noqa: F401

#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches, max_bytes: int = 4 << 20, column: int = 1):
    """Record batches cut so that each holds about max_bytes of the text column, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(1, batch.column(column).nbytes)
        step = max(1, int(n * max_bytes / size))
        for at in range(0, n, step):
            yield batch.slice(at, step)


#: What row_key() gives.
ROW_KEY = "struct<x:long,y:long>"


def row_key() -> F.Column:
    """128 bits that name a row by doc_id and text."""
    both = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.struct(F.xxhash64(*both).alias("x"), F.xxhash64(F.lit(1), *both).alias("y"))


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def columns_apart(work):
    """For operators from docs to docs: columns beyond those of documents go through the work under names that clash with none of its own."""

    @functools.wraps(work)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        names = docs.columns
        renamed = docs.toDF(*[x if x in DOCUMENT else f"x{i}x" for i, x in enumerate(names)])
        return work(renamed, *args, **options).toDF(*names)

    return run


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def in_training_fold(mod: int, held: int):
    """False for rows held out: crc32 of doc_id as text leaves `held` modulo `mod`. A null id trains."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != held, F.lit(True))
