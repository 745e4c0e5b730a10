"""Exact top-k by inner product with MaxScore over shards.

A vector's dimensions are its terms. In a shard, dimension d contributes to query q between q_d * low_d
and q_d * high_d; above that floor the contributions are postings' impacts, none negative. Terms are
taken from the largest possible impact down. Those whose impacts together cannot lift a vector over the
query's k-th best score so far are non-essential: vectors are found through all essential terms'
postings, and the others are probed in steps for the vectors that stay competitive. Vectors are dense, so
a term's postings are a column of the shard. Queries in blocks and shards in groups make a grid of
cells; a task carries the best k of a cell's queries from shard to shard, and the cells' lists are merged by score and id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import staged

SHARD = 4096
#: Queries of a block, about: what a task holds.
BLOCK = 8192
#: Shards of a group: what a cell's lists stand for.
GROUP = 64
PROBE = 8
SCALE = 64


def _vectors(column, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows take part, and their vectors: not null, nothing null or not finite inside."""
    ok, out = [], []
    for i, v in enumerate(column):
        x = v.values
        if x is None or x.null_count:
            continue
        x = np.floor(x.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        if np.isfinite(x).all():
            ok.append(i)
            out.append(x)
    return np.array(ok, dtype=np.int64), out


def shards(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE, size: int = SHARD) -> DataFrame:
    """Rows of up to `size` vectors: ids and components, floor(scale * x), as bytes of little-endian 64-bit integers. Rows without an id take no part."""

    def pack(ids, rows):
        wide = max(map(len, rows), default=0)
        m = np.zeros((len(rows), wide), np.int64)
        for r, x in zip(m, rows, strict=True):
            r[: len(x)] = x
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([m.astype("<i8").tobytes()], pa.binary()), pa.array([wide], pa.int32())], ["ids", "parts", "wide"])

    def run(batches):
        ids, rows = [], []
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                ok, found = _vectors(part.column(1), scale)
                ids += part.column(0).take(pa.array(ok)).to_pylist()
                rows += found
                while len(rows) >= size:
                    yield pack(ids[:size], rows[:size])
                    ids, rows = ids[size:], rows[size:]
        if rows:
            yield pack(ids, rows)

    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), column)
    return rows.mapInArrow(run, "ids binary, parts binary, wide int").withColumn("shard", F.monotonically_increasing_id())


def unpack(ids: bytes, parts: bytes, wide: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(parts, "<i8").reshape(len(i), wide)


class Block:
    """Queries: ids, vectors, and the shard and row each comes from, so that a query never meets itself."""

    def __init__(self, ids, vectors, shard, row):
        self.ids, self.vectors, self.shard, self.row = ids, vectors, shard, row


def _better(scores, ids, k):
    """The k best by score, then by smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Searcher:
    """Keeps the best k of each query of a block while shards pass."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in block.ids]
        self.probed = self.skipped = 0

    def pass_shard(self, shard: int, ids: np.ndarray, parts: np.ndarray) -> None:
        if not len(ids):
            return
        queries = self.block.vectors
        wide = max(parts.shape[1], queries.shape[1])
        low = np.zeros(wide, np.int64)
        high = np.zeros(wide, np.int64)
        low[: parts.shape[1]], high[: parts.shape[1]] = parts.min(0), parts.max(0)
        most = float(np.abs(parts).max(initial=0)) * float(np.abs(queries).max(initial=0)) * wide
        # exact in each: sums reach twice the bound once the floor is taken off, thrice when it is compared
        kind = np.float32 if most < 2**22 else np.float64 if most < 2**51 else np.int64
        columns = np.zeros((wide, len(ids)), kind)
        columns[: parts.shape[1]] = parts.T
        for i in range(len(self.block.ids)):
            q = np.zeros(wide, np.int64)
            q[: queries.shape[1]] = queries[i]
            own = int(self.block.row[i]) if self.block.shard[i] == shard else -1
            self.search(i, q, own, ids, columns, np.minimum(q * low, q * high), np.maximum(q * low, q * high), kind)

    def search(self, i, q, own, ids, columns, floor, top, kind) -> None:
        impact = top - floor
        terms = np.argsort(-impact, kind="stable")
        terms = terms[impact[terms] > 0]
        base = int(floor.sum())  # what every vector has at least
        rest = np.r_[np.cumsum(impact[terms][::-1])[::-1], 0]  # what terms from here on can add
        scores, kept = self.best[i]
        bar = int(scores[-1]) if len(scores) == self.k else None  # ties count: a smaller id may win
        essential = len(terms) if bar is None else int(np.searchsorted(-rest, -(bar - base), side="right"))
        if bar is not None and essential == 0 and base + int(rest[0]) < bar:
            self.skipped += len(ids)
            return
        first = terms[: max(PROBE, essential)]
        total = q[first].astype(kind) @ columns[first] - kind(int(floor[first].sum()))
        at, live = len(first), None
        if own >= 0:
            live = np.delete(np.arange(len(ids)), own)
            total = total[live]
        while at < len(terms):
            if bar is not None:  # non-essential terms are probed for what is still competitive
                fit = total + kind(base + int(rest[at])) >= bar
                live = np.flatnonzero(fit) if live is None else live[fit]
                total = total[fit]
                if not len(live):
                    break
            more = terms[at : at + PROBE] if bar is not None else terms[at:]
            part = columns[more] if live is None else columns[np.ix_(more, live)] if len(live) < columns.shape[1] // 2 else columns[more][:, live]
            self.probed += part.shape[1]
            total = total + q[more].astype(kind) @ part - kind(int(floor[more].sum()))
            at += len(more)
        if live is not None and not len(live):
            return
        scores_new = total.astype(np.int64) + base
        names = ids if live is None else ids[live]
        if bar is not None:
            fit = scores_new >= bar
            scores_new, names = scores_new[fit], names[fit]
        elif len(scores_new) > 4 * self.k:
            cut = np.partition(scores_new, len(scores_new) - self.k)[len(scores_new) - self.k]
            fit = scores_new >= cut
            scores_new, names = scores_new[fit], names[fit]
        self.best[i] = _better(np.r_[scores, scores_new], np.r_[kept, names], self.k)

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.best]
        who = [np.repeat(x, n) for x in (self.block.shard, self.block.row, self.block.ids)]
        found = [np.concatenate([np.zeros(0, np.int64), *x]) for x in ([i for _, i in self.best], [s for s, _ in self.best])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*who, *found)], ["shard", "row", "query_id", "vec_id", "score"])


def _block(held) -> Block:
    wide = max(m.shape[1] for _, m, _, _ in held)
    vectors = np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for _, m, _, _ in held])
    return Block(np.concatenate([h[0] for h in held]), vectors, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))


def _search(k: int):
    """Rows (cell, kind, ids, parts, wide, shard, rows) sorted by cell and kind, a cell's queries (kind 0) before its shards: lists of the best."""

    def run(batches):
        now, held, searcher = None, [], None
        for b in batches:
            for cell, kind, ids, parts, wide, shard, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cell != now:
                    if searcher is not None:
                        yield searcher.rows()
                    now, held, searcher = cell, [], None
                i, m = unpack(ids, parts, wide)
                if kind == 0:
                    held.append((i, m, np.full(len(i), shard), np.frombuffer(rows, "<i8")))
                    continue
                if searcher is None:
                    if not held:  # no query fell into the cell's block
                        continue
                    searcher = Searcher(_block(held), k)
                searcher.pass_shard(shard, i, m)
        if searcher is not None:
            yield searcher.rows()

    return run


def query_rows(packed: DataFrame, every: int) -> DataFrame:
    """The queries of each shard: rows whose id is divisible by `every`, with their places in the shard."""

    def run(batches):
        for b in batches:
            for ids, parts, wide, shard in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i, m = unpack(ids, parts, wide)
                rows = np.flatnonzero(i % every == 0)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((i[rows].tobytes(), pa.binary()), (m[rows].tobytes(), pa.binary()), (wide, pa.int32()), (shard, pa.int64()), (rows.astype("<i8").tobytes(), pa.binary()), (len(rows), pa.int64()))], ["ids", "parts", "wide", "shard", "rows", "n"])

    return packed.mapInArrow(run, "ids binary, parts binary, wide int, shard long, rows binary, n long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores among all rows but its own, ties to the smaller id.

    Queries are the rows whose vec_id is divisible by `every`; repeated rows are queries of their own and
    candidates for each other. Null ids, null vectors and vectors with a null or non-finite component take
    no part; a shorter vector counts as filled with zeros. Scores must stay below 2 ** 61. The driver sees two counts:
    blocks of queries meet groups of shards in cells, dealt by a shuffle.
    """
    spark = vectors.sparkSession
    packed = staged(shards(vectors, scale=scale, size=shard), "shards")
    queries = staged(query_rows(packed, every), "queries")
    blocks = max(1, -(-(queries.agg(F.sum("n")).first()[0] or 0) // block))
    n = packed.count()
    groups = max(1, -(-n // group), min(n, -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    own_block, own_group = (F.pmod(F.xxhash64("shard", F.lit(x)), F.lit(y)) for x, y in ((1, blocks), (2, groups)))
    each = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long")))
    asked = queries.select("*", own_block.alias("a"), each(groups).alias("b")).withColumn("kind", F.lit(0))
    given = packed.select("*", F.lit(None).cast("binary").alias("rows"), own_group.alias("b"), each(blocks).alias("a")).withColumn("kind", F.lit(1))
    names = ["cell", "kind", "ids", "parts", "wide", "shard", "rows"]
    cells = asked.drop("n").unionByName(given).withColumn("cell", F.col("a") * groups + F.col("b")).select(*names)
    dealt = cells.repartition(blocks * groups, "cell").sortWithinPartitions("cell", "kind")
    found = dealt.mapInArrow(_search(k), "shard long, row long, query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("shard", "row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
