"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints at most two bits apart agree on four of six bit blocks, so each distinct fingerprint goes
to the 15 choices of four blocks and meets there all it may link to. Within a bucket fingerprints are
sorted by Gray rank; neighbours share most bits, and a tree over them keeps in each node the bits all
its members share. A search carries the differences counted so far down the tree, counts only the
bits a node adds, and drops a whole group once they exceed the limit. A bucket has at most
2 ** 22 members, as that is how many bits its key leaves free.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ROW_KEY, columns_apart, discard, pieces, row_key, staged, texts
from quire.llm.components import components

SHINGLE = 3
DIFFER = 2
SEED = 42
FAN = 8
#: (first bit, width) of the blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64 bits, each set if it is set in more than half of the hashes of the word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :][:n].tolist()
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in more than half of the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, fp) for every row; fp is the fingerprint as a signed long, 0 for null or wordless texts; row_key names id and text."""

    def run(batches):
        for b in pieces(batches):
            fps = np.array([fingerprint(t, width) for t in texts(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], ["doc_id", "row_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("row_key"))
    return rows.mapInArrow(run, f"doc_id long, row_key {ROW_KEY}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each pattern in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Trees over segments of fingerprints; within a segment they are sorted by Gray rank."""

    def __init__(self, fps: np.ndarray, segment: np.ndarray, fan: int = FAN):
        order = np.lexsort((gray_rank(fps), segment))
        self.order, self.fps, self.segment = order, fps[order], segment[order]
        level_and = level_or = self.fps
        owner = self.segment
        first = np.arange(len(fps))
        #: From leaves to roots: shared bits, their values, first child and end of children in the level below.
        self.levels = [(np.full(len(fps), ~np.uint64(0)), self.fps, first, first + 1)]
        while len(owner) and (owner[1:] == owner[:-1]).any():
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
            cut = np.flatnonzero(place % fan == 0)
            level_and, level_or = np.bitwise_and.reduceat(level_and, cut), np.bitwise_or.reduceat(level_or, cut)
            mask = ~(level_and ^ level_or)
            self.levels.append((mask, level_and & mask, cut, np.r_[cut[1:], len(owner)]))
            owner = owner[cut]
        self.root_segment = owner

    def links(self, most: int, wide: int = 1 << 20):
        """Yields arrays (i, j), i > j in sorted order, of members of a segment that differ in `most` bits or fewer.

        Queries go in blocks that can reach `wide` members in all, or one at a time, so memory is bounded.
        """
        if not len(self.fps):
            return
        _, place, size = np.unique(self.segment, return_inverse=True, return_counts=True)
        block = np.cumsum(size[place]) // wide
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(self.fps)]):
            q = np.arange(at, end)
            node = np.searchsorted(self.root_segment, self.segment[q])
            done = np.zeros(len(q), np.uint8)
            above = np.zeros(len(q), np.uint64)  # bits that are counted already
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, value, first, stop = self.levels[depth]
                own = mask[node]
                done = done + np.bitwise_count((self.fps[q] ^ value[node]) & own & ~above)
                keep = done <= most
                q, node, done, own = q[keep], node[keep], done[keep], own[keep]
                if depth == 0:
                    pair = q > node
                    yield q[pair], node[pair]
                    break
                width = stop[node] - first[node]
                start = np.repeat(first[node] - np.r_[0, np.cumsum(width)[:-1]], width)
                child = start + np.arange(width.sum())
                q, done, above = np.repeat(q, width), np.repeat(done, width), np.repeat(own, width)
                node = child
                if depth == 1:  # children are leaves: each pair is wanted once
                    keep = node < q
                    q, node, done, above = q[keep], node[keep], done[keep], above[keep]


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root names the least known member of each member's group; the same after adding links a-b."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not ((up := root[root]) == root).all():
            root = up
    return root


def _bucket_links(batches):
    """Rows (part, key, fp) sorted by part and key, buckets whole in a task: a star of edges for each linked group."""
    held: list[np.ndarray] = []
    count = 0

    def flush(key, fps):
        alone = np.r_[True, key[1:] != key[:-1]]
        segment = np.cumsum(alone) - 1
        size = np.bincount(segment)
        some = size[segment] > 1
        segment, fps = segment[some], fps[some]
        index = GrayIndex(fps, segment)
        root = np.arange(len(fps))
        for a, b in index.links(DIFFER):
            root = unite(root, a, b)
        linked = np.flatnonzero(root != np.arange(len(root)))
        own = index.fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[root[linked]])], ["a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        held.append(rows)
        count += rows.shape[1]
        if count < 100_000:
            continue
        part, key, fp = np.concatenate(held, axis=1)
        change = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]))
        if len(change):
            cut = change[-1] + 1
            held, count = [np.stack([part[cut:], key[cut:], fp[cut:]])], len(part) - cut
            yield flush(part[:cut] * (1 << 50) + key[:cut], fp[:cut].view(np.uint64))
        else:
            held = [np.stack([part, key, fp])]
    if held and count:
        part, key, fp = np.concatenate(held, axis=1)
        yield flush(part * (1 << 50) + key, fp.view(np.uint64))


def bucket_keys(fps: DataFrame) -> DataFrame:
    """(part, key, fp): the bits of four of the six blocks, for each choice of four."""
    choices = []
    for part, blocks in enumerate(combinations(BLOCKS, len(BLOCKS) - DIFFER)):
        key, at = F.lit(0).cast("long"), 0
        for first, width in blocks:
            bits = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(bits, at))
            at += width
        choices.append(F.struct(F.lit(part).alias("part"), key.alias("key")))
    return fps.select("fp", F.explode(F.array(*choices)).alias("c")).select("c.part", "c.key", "fp")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (fp) that differ in DIFFER bits or fewer to join all that are linked."""
    keyed = bucket_keys(fps).repartition("part", "key").sortWithinPartitions("part", "key")
    return keyed.mapInArrow(_bucket_links, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, row_key, fingerprint (16 hex digits), component_id, component_fp, n_links.

    component_id is the least doc_id reachable over links (null only if the component has no id at all),
    component_fp the component's least fingerprint, n_links the number of other distinct fingerprints in
    the component. Equal fingerprints are one class from the start, so a third of all rows being copies
    is one row in every later step. Null and empty texts have fingerprint zero. No rows, no result rows.
    """
    rows = staged(fingerprints(docs, width), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = components(links(classes.select("fp")))
    joined = classes.join(found.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    joined = staged(joined, "labelled")
    firsts = joined.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    named = staged(joined.join(firsts, "label").select("fp", "label", "component_id", (F.col("n") - 1).alias("n_links")), "named")
    discard(classes, found, joined)
    return rows.join(named, "fp").select(
        "doc_id", "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("label").alias("component_fp"), "n_links"
    )


@columns_apart
def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row left of each component: the one with the least id, null ids last; of equal rows one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    kept = staged(near_duplicates(docs, **options).groupBy("component_fp").agg(first.alias("f")).select(F.col("f.row_key").alias("_key")), "kept")
    once = docs.withColumn("_key", row_key()).dropDuplicates(["_key"])
    return once.join(kept, "_key", "left_semi").select(docs.columns)
