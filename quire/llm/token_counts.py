"""Token counts of documents in flat token files by a separator scan.

A token file is ids one after the other, each document followed by the end-of-document id, without an
index. Files are cut into blocks of equal size wherever that falls. Each block is searched for
separators in one vectorised pass and gives a summary: tokens, separators, first and last separator,
lengths between them. A prefix scan over the summaries' few numbers carries the last separator and the
number of documents so far into each block, which completes the document that crosses its start. The
scan has two levels, runs of blocks and blocks of a run, so a file of any size is spread over tasks.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.bpe import encoder
from quire.llm.common import pieces, staged

#: Tokens of a block, and blocks of a run.
BLOCK = 1 << 16
RUN = 1 << 10


def special_id(path: str, token: str = "<|endoftext|>") -> int:
    """Id of a special token in a `tokenizers` JSON file, which must have it."""
    with open(path, encoding="utf-8") as file:
        found = [t["id"] for t in json.load(file)["added_tokens"] if t["content"] == token]
    if not found:
        raise ValueError(f"{path} has no {token}")
    return found[0]


def token_table(docs: DataFrame, path: str, eod: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Token shards of docs, one per task: rows (file, block, data) of flat ids, and a row with block -1 whose data are the shard's doc_ids in order.

    A null id is written as the least long. Texts are encoded whole, special tokens' strings as ordinary text, so no text holds eod.
    A vocabulary with ids that `width` bytes can't hold is refused.
    """
    if encoder(path, False).size > 1 << 8 * width:
        raise ValueError(f"{path}: ids up to {encoder(path, False).size - 1} need more than {width} bytes")

    def run(batches):
        e, kind = encoder(path, False), f"<u{width}"
        held, ids, n, end = b"", [], 0, np.array([eod], kind).tobytes()
        import uuid

        file = uuid.uuid4().hex
        for b in pieces(batches):
            parts = [held]
            for d, codes in zip(b.column(0).to_pylist(), e.encode_batch([t or "" for t in b.column(1).to_pylist()]), strict=True):
                parts += [np.frombuffer(codes, "<u4").astype(kind).tobytes(), end]
                ids.append(-(1 << 63) if d is None else d)
            held = b"".join(parts)
            full = len(held) // (block * width)
            if full:
                cut = [held[i * block * width : (i + 1) * block * width] for i in range(full)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * full), pa.array(range(n, n + full), pa.int64()), pa.array(cut, pa.binary())], ["file", "block", "data"])
                held, n = held[full * block * width :], n + full
        if ids:
            rows = [(n, held)] * bool(held) + [(-1, np.array(ids, "<i8").tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["file", "block", "data"])

    return staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, block long, data binary"), "tokens")


def read_blocks(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of flat binary token files, which must hold whole ids.

    Files of any size are dealt in ranges of READ bytes, which tasks read by themselves from any store pyarrow opens by its address.
    """
    step = max(1, READ // (block * width)) * block * width
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # lengths only: no content is read
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step).cast("long"))
    parts = files.select("path", "length", F.explode(starts).alias("at"))
    parts = parts.repartition(max(1, min(parts.count(), 4 * spark.sparkContext.defaultParallelism)), "path", "at")

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for name, length, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if length % width:
                    raise ValueError(f"{name}: {length} bytes are no whole ids")
                store, where = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", name))
                with store.open_input_file(where) as file:
                    for i in range(at, min(length, at + step), block * width):
                        n = min(block * width, length - i)
                        data = file.read_at(n, i)
                        if len(data) != n:
                            raise ValueError(f"{name}: {len(data)} of {n} bytes at {i}")
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i // (block * width)], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

    return parts.mapInArrow(run, "file string, block long, data binary")


#: Bytes a task reads of a file at a time.
READ = 1 << 26
SUMMARY = "file string, block long, n long, n_ends long, first long, last long, inner array<long>"


def scan_blocks(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """A block's tokens, separators, first and last separator (null: none) and the lengths between its separators."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out: list[list] = [[] for _ in range(5)]
                for data in part.column(2).to_pylist():
                    ids = np.frombuffer(data, f"<u{width}")
                    ends = np.flatnonzero(ids == eod)
                    has = len(ends) > 0
                    for col, v in zip(out, (len(ids), len(ends), int(ends[0]) if has else None, int(ends[-1]) if has else None, np.diff(ends) - 1 if has else []), strict=True):
                        col.append(v)
                kinds = (pa.int64(),) * 4 + (pa.list_(pa.int64()),)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["file", "block", "n", "n_ends", "first", "last", "inner"])

    return blocks.mapInArrow(run, SUMMARY)


def count_tokens(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of each document, ordinal from 0 in a file; separators are not counted.

    Documents without tokens count 0. Tokens after a file's last separator are a document that has not ended.
    blocks(file, block, data): the blocks of a file in order, of any sizes.
    """
    summaries = staged(scan_blocks(blocks, eod, width), "summaries")
    scanned = staged(_scan(summaries.drop("inner")), "scan")
    s = scanned.join(summaries.select("file", "block", "inner"), ["file", "block"])
    crossing = F.col("start") + F.col("first") - F.col("since") - 1
    lengths = F.when(F.col("n_ends") > 0, F.concat(F.array(crossing), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    ended = s.select("file", "done", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("done") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    tail = F.col("start") + F.col("n") - F.greatest("since", F.coalesce("end_at", "since")) - 1
    rest = scanned.where("is_last").select("file", (F.col("done") + F.col("n_ends")).alias("ordinal"), tail.alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.unionByName(rest)


def _scan(s: DataFrame) -> DataFrame:
    """Summaries with what comes before each block: start, tokens; done, separators; since, place of the last separator (-1: none). is_last: of the file.

    Blocks are scanned within runs of RUN and runs within files, so no task holds more than one of either.
    """
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    s = s.withColumn("run", F.floor(F.col("block") / RUN).cast("long"))
    before = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("start", F.coalesce(F.sum("n").over(before), zero)).withColumn("done", F.coalesce(F.sum("n_ends").over(before), zero))
    s = s.withColumn("end_at", F.col("start") + F.col("last")).withColumn("since", F.max("end_at").over(before))
    runs = s.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends"), F.max("end_at").alias("end_at"), F.max("block").alias("top"))
    over, whole = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    runs = runs.withColumn("run_start", F.coalesce(F.sum("n").over(over), zero)).withColumn("run_done", F.coalesce(F.sum("n_ends").over(over), zero))
    runs = runs.withColumn("run_since", F.coalesce(F.max(F.col("run_start") + F.col("end_at")).over(over), none)).withColumn("top", F.max("top").over(whole))
    s = s.join(runs.select("file", "run", "run_start", "run_done", "run_since", "top"), ["file", "run"])
    since = F.coalesce(F.col("since") + F.col("run_start"), F.col("run_since"))
    return s.select(
        "file", "block", "n", "n_ends", "first", (F.col("run_start") + F.col("start")).alias("start"), (F.col("run_done") + F.col("done")).alias("done"),
        (F.col("run_start") + F.col("end_at")).alias("end_at"), since.alias("since"), (F.col("block") == F.col("top")).alias("is_last"),
    )


def count_documents(docs: DataFrame, path: str, eod: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of every row of docs, counted in the flat files it is written to.

    Null and empty texts count 0; repeated ids keep a row each. An empty table gives no rows.
    """
    shards = token_table(docs, path, eod, width, block)
    counts = count_tokens(shards.where("block >= 0"), eod, width)

    def ids(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = np.frombuffer(data, "<i8")
                missing = found == -(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found)), pa.array(np.arange(len(found))), pa.array(found, mask=missing)], ["file", "ordinal", "doc_id"])

    names = shards.where("block = -1").mapInArrow(ids, "file string, ordinal long, doc_id long")
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
