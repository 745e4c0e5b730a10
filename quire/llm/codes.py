"""Codes of vectors: parts of integer vectors as indexes into codebooks that rounds of assigning and averaging fit.

Codebooks are integers, broadcast: `entries` rows as wide as a vector. A task computes the distances of an
Arrow batch to all entries of a part at once, |x|^2 - 2 x.b + |b|^2 in 64-bit integer matrix products, and takes
the first least. For fitting it adds up its rows by entry, so a round's shuffle carries one row for each
entry, place and task, however often one vector or entry occurs; the sums of a codebook are all the driver sees.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import staged

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Rows whose distances are computed at once: what a task holds besides its batch.
ROWS = 2048
#: So many labels' sums are broadcast; more are joined.
LABELS = 10_000


def _kept(vectors: DataFrame, key: str, column: str, label: str) -> DataFrame:
    """(vec_id, label, embedding) of vectors that are not null and hold nothing null or not finite."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("embedding"))
    finite = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    return rows.where(F.col("embedding").isNotNull() & finite)


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each vector, filled with zeros up to the width; refuses what 64 bits might not hold."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    if np.abs(x).max(initial=0) >= (2**61 / max(1, width)) ** 0.5:
        raise ValueError(f"a component is too large for exact distances over {width} dimensions")
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return x.astype(np.int64).reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = x
    return out


def nearest(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (n, width) and part of books (parts, entries, part's width): the nearest entry, the first of equals, and its squared distance."""
    parts, _, wide = books.shape
    index, far = np.empty((len(rows), parts), np.int64), np.empty((len(rows), parts), np.int64)
    for p, book in enumerate(books):
        x = rows[:, p * wide : (p + 1) * wide]
        d = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
        index[:, p] = d.argmin(1)
        far[:, p] = d[np.arange(len(rows)), index[:, p]]
    return index, far


def _slices(batches, at: int, width: int, scale: int):
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part, integers(part.column(at), width, scale)


def _sums(kept: DataFrame, shared, width: int, scale: int) -> DataFrame:
    """(part, entry, place, total, n): components summed by the entry that their part is nearest to."""

    def run(batches):
        books = shared.value
        parts, entries, wide = books.shape
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, rows in _slices(batches, 0, width, scale):
            index, _ = nearest(rows, books)
            for p in range(parts):
                np.add.at(total[p], index[:, p], rows[:, p * wide : (p + 1) * wide])
                n[p] += np.bincount(index[:, p], minlength=entries)
        p, e = np.nonzero(n)
        cells = [np.repeat(p, wide), np.repeat(e, wide), np.tile(np.arange(wide), len(p)), total[p, e].ravel(), np.repeat(n[p, e], wide)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cells], ["part", "entry", "place", "total", "n"])

    found = kept.select("embedding").mapInArrow(run, "part long, entry long, place long, total long, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks (parts, entries, part's width) after the rounds; None without vectors. kept(vec_id, embedding) holds finite vectors.

    They start as the parts of the `entries` smallest ids (null ids last, equal ids by vector; all, if there are fewer). A vector
    shorter than the longest, or whose length the parts do not divide, counts as filled with zeros. An entry that no part is nearest to stays.
    """
    sc = kept.sparkSession.sparkContext
    first = kept.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    if not first:
        return None
    width = kept.agg(F.max(F.size("embedding"))).first()[0]
    width = max(1, -(-width // parts)) * parts
    books = integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), width, scale)
    books = books.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = sc.broadcast(books)
        for r in _sums(kept, shared, width, scale).collect():
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
        shared.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(kept: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error): the nearest entries of all parts, two hex digits each, and their squared distances summed."""
    parts, entries, wide = books.shape
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for part, rows in _slices(batches, 2, parts * wide, scale):
            index, far = nearest(rows, shared.value)
            codes = index.astype(np.uint8).tobytes().hex()
            codes = [codes[i : i + 2 * parts] for i in range(0, len(codes), 2 * parts)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all vectors but null ones and ones with a null or non-finite component.

    label_error sums error over rows of equal label, null ones together. Repeated rows and ids come back as often as they are
    there, null ids too; no vectors give no rows. Other columns are not read. A scaled component of 2 ** 27 or more at 64 dimensions is refused, as its distances might not be exact.
    """
    kept = _kept(vectors, key, column, label)
    books = fit(kept, parts, entries, rounds, scale)
    out = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if books is None:
        return kept.sparkSession.createDataFrame([], out)
    coded = staged(encode(kept, books, scale), "codes")
    sums = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "label-errors")
    few = sums.limit(LABELS + 1).count() <= LABELS
    got = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of_label")))
    return got.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
