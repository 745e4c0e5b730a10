"""Near copies by the Jaccard similarity of word shingles: SimHash links and MinHash bands find candidates, the shingle sets decide.

Rows of one shingle set are one class. The Gray-order index of SimHash fingerprints, here of five-word shingles, names the
first candidates. At a similarity of 0.8 two fingerprints differ in about ten of 64 bits, which no choice of blocks can
search, so bands complete it: classes that agree on a band of minima meet in a bucket. A small
bucket compares all its pairs; a large one compares its members with a few pivots a round, more
the next, and leaves out pairs that earlier links have joined, until each bucket is one group or compared
in full. So a group of near copies costs its members, not their pairs. Pairs of texts of over SKETCH shingles are first judged by
sketches: of those at a similarity of 0.8 about 3 in a million look like less than ALIKE there, and are lost to that bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.common import ROW_KEY, columns_apart, discard, pieces, row_key, staged, texts
from quire.llm.components import components

SHINGLE = 5
#: Least Jaccard similarity of a link.
SIMILAR = 0.8
SEED = 42
#: Two sets of similarity s share no bucket with a chance of (1 - s ** ROWS) ** BANDS: 3 in a million at 0.8.
BANDS, ROWS = 32, 5
#: Members up to which a bucket compares all its pairs at once; pivots of a larger bucket in the first round.
SMALL, PIVOTS = 64, 8
#: How many times as many pivots the next round has.
MORE = 7
#: Least hashes of a set that its sketch holds: all of most texts, whose pairs it settles but for the check of what it finds.
SKETCH = 512
#: For longer texts the share of common ones among the least of both from which texts are compared: 4.5 standard deviations below SIMILAR.
ALIKE = 0.72
#: Members of a bucket that one task compares with the pivots.
SLICE = 4096
#: Parts over which the comparisons with one pivot are dealt.
PARTS = 256

_rng = np.random.default_rng(5)
_FACTOR = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the word shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    return np.unique(hashes(text, width))


def hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The hashes of the word shingles in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :][:n].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)


def bands(found: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band: the hash of ROWS minima under as many hash functions."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 512):
        x = found[at : at + 512, None] * _FACTOR + _ADD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, x.min(0), out=least)
    return [xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k) - (1 << 63) for k in range(0, BANDS * ROWS, ROWS)]


def sketch(found: np.ndarray) -> np.ndarray:
    """The upper halves of the SKETCH least hashes of an ascending set."""
    return (found[:SKETCH] >> np.uint64(32)).astype("<u4")


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two ascending sets have the similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, cls, n, fp, bands, sig) of every row; cls names the shingle set by 128 bits, n is its size, fp the fingerprint, sig its sketch."""

    def run(batches):
        for b in pieces(batches):
            all_ = [hashes(t) for t in texts(b.column(1))]
            fp = np.array([simhash.majority(x) if len(x) else 0 for x in all_], np.uint64).view(np.int64)
            found = [np.unique(x) for x in all_]
            cls = [xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in found]
            keys = [bands(x) if len(x) else [] for x in found]
            sig = [sketch(x).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cls, pa.binary()), pa.array([len(x) for x in found], pa.int64()), pa.array(fp), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "row_key", "cls", "n", "fp", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("row_key"))
    return rows.mapInArrow(run, f"doc_id long, row_key {ROW_KEY}, cls binary, n long, fp long, bands array<long>, sig binary")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text) of the classes wanted, given as (cls, row_key)."""
    rows = docs.select(row_key().alias("row_key"), F.col("text").cast("string").alias("text")).join(wanted, "row_key").select("cls", "text")
    return rows.dropDuplicates(["cls"])


def _links(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar; texts are sent, as they are smaller than their sets. A pivot b of many pairs is sent to as many parts, so no task gathers them."""

    def run(batches):
        last, own = None, None
        for batch in pieces(batches, 8 << 20, 2):
            keep = []
            for a, name, b in zip(texts(batch.column(2)), batch.column(1).to_pylist(), texts(batch.column(3)), strict=True):
                if name != last:
                    last, own = name, shingles(b)
                keep.append(similar(shingles(a), own))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(PARTS)))
    pivots = pairs.select("b", "part").distinct().join(found.select(F.col("cls").alias("b"), F.col("text").alias("right")), "b")
    both = pairs.join(found.select(F.col("cls").alias("a"), F.col("text").alias("left")), "a").join(pivots, ["b", "part"])
    return both.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary")


def _alike(members: DataFrame, heads: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b), a > b: members and heads of a bucket that carry different labels and are similar by their sketches, once for a member and a label. A large bucket's members go in slices, its heads to each."""

    def run(batches):
        bucket, heads_ = None, []
        names = ["kind", "band", "key", "salt", "cls", "n", "label", "sig"]
        for batch in pieces(batches, 1 << 20, 7):
            cols = dict(zip(names, (c.to_pylist() for c in batch.columns), strict=True))
            where = list(zip(cols["band"], cols["key"], cols["salt"]))
            at = 0
            while at < len(where):
                end = at
                while end < len(where) and where[end] == where[at] and cols["kind"][end] == cols["kind"][at]:
                    end += 1
                rows = list(zip(*(cols[x][at:end] for x in ("cls", "n", "label", "sig"))))
                if where[at] != bucket:
                    bucket, heads_ = where[at], []
                if cols["kind"][at] == 0:
                    heads_ += rows
                elif heads_:
                    a, b = _compared(rows, heads_)
                    if a:
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                at = end

    slices = F.ceil(F.col("size") / SLICE).cast("long")
    given = members.withColumn("salt", F.pmod(F.xxhash64("cls"), slices)).withColumn("kind", F.lit(1))
    asked = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).withColumn("kind", F.lit(0))
    columns = ["kind", "band", "key", "salt", "cls", "n", "label", "sig"]
    asked, given = (x.join(sketches, "cls").select(columns) for x in (asked, given))
    both = asked.unionByName(given).repartition("band", "key", "salt").sortWithinPartitions("band", "key", "salt", "kind")
    return both.mapInArrow(run, "a binary, b binary")


def _compared(rows: list[tuple], heads: list[tuple]) -> tuple[list[bytes], list[bytes]]:
    """Pairs of rows and heads (cls, n, label, sketch), the greater cls first, that differ in label and are similar by their sketches.

    Whole sketches give the similarity but for hashes that share their upper half, which can only raise it. So a row that is clearly similar to a head needs no other head of that label.
    """
    sig = [np.frombuffer(r[3], "<u4") for r in rows]
    all_, n, number = np.concatenate(sig), np.array([r[1] for r in rows]), {}
    starts = np.cumsum([0, *map(len, sig[:-1])])
    label = np.array([number.setdefault(r[2], len(number)) for r in rows])
    a, b, joined = [], [], set()
    for cls, size, name, s in heads:
        own = np.frombuffer(s, "<u4")
        own_label = number.setdefault(name, len(number))
        at = np.flatnonzero((np.minimum(n, size) >= SIMILAR * np.maximum(n, size)) & (label != own_label))
        if not len(at):
            continue
        both = np.add.reduceat(own[np.minimum(np.searchsorted(own, all_), len(own) - 1)] == all_, starts, dtype=np.int64)
        for i in at.tolist():
            if rows[i][0] < cls or (i, own_label) in joined:
                continue
            if max(n[i], size) <= SKETCH:
                if both[i] < SIMILAR * (n[i] + size - both[i]):
                    continue
                if both[i] - 2 >= SIMILAR * (n[i] + size - both[i] + 2):
                    joined.add((i, own_label))
            else:
                least = np.union1d(sig[i], own)[:SKETCH]
                if np.isin(least, sig[i]).astype(int) @ np.isin(least, own) < ALIKE * len(least):
                    continue
            a.append(rows[i][0])
            b.append(cls)
    return a, b


def _linked_by_simhash(classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of classes that the Gray-order index links: those of one fingerprint with the least of them, and these along the links."""
    named = staged(classes.groupBy("fp").agg(F.min("cls").alias("top")), "named")
    same = classes.join(named, "fp").where("cls > top").select(F.col("cls").alias("a"), F.col("top").alias("b"))
    edges = simhash.links(named.select("fp"))
    ends = (named.select(F.col("fp").alias(x), F.col("top").alias(f"top_{x}")) for x in ("a", "b"))
    near = edges.join(next(ends), "a").join(next(ends), "b").select(F.greatest("top_a", "top_b").alias("a"), F.least("top_a", "top_b").alias("b"))
    out = staged(same.union(near).distinct(), "gray")
    discard(named)
    return out


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after adding links (a, b): the components of the links between labels, so what is joined already is not gone through again."""
    ends = [labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in ("a", "b")]
    edges = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    up = components(edges)
    alone = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti")
    nodes = labels.select("node", "label").unionByName(alone.withColumn("label", F.col("node")))
    out = nodes.join(up.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = staged(out, "joined")
    discard(up)
    return out


def _compare(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(cls, label) of all linked classes, label the least class of the group; None without candidates.

    First each class is compared with one other, the least of those at the head of its buckets, and with its SimHash links. Of a large
    group of near copies that joins nearly all, a pair a class. Buckets that hold several groups after that go through rounds of pivots.
    """
    gray = _linked_by_simhash(classes)
    keyed = classes.select("cls", "n", F.posexplode("bands").alias("band", "key"))
    full = keyed.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("cls").alias("head")).where("size > 1")
    members = staged(keyed.join(full.hint("merge"), ["band", "key"]), "members")
    heads = members.where("cls > head").groupBy(F.col("cls").alias("a")).agg(F.min("head").alias("b"))
    pairs = staged(heads.union(gray).distinct(), "pairs")
    discard(gray)
    if not pairs.limit(1).count():
        discard(members, pairs)
        return None
    some = members.select("cls").union(pairs.select("a")).union(pairs.select("b")).distinct()
    found = staged(_texts(docs, some.join(classes.select("cls", "row_key"), "cls")), "texts")
    members_now = members.drop("head")
    links = staged(_links(pairs, found), "links")
    labels, tried, pivots, old = components(links), pairs, PIVOTS, [pairs]
    while True:
        left = members_now.drop("label").join(labels.withColumnsRenamed({"node": "cls"}), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        open_ = left.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        rest = staged(left.drop("size").join(open_.select("band", "key", "size"), ["band", "key"]).select("band", "key", "cls", "n", "size", "label"), "members")
        discard(members)
        members = rest
        if not members.limit(1).count():
            break
        rank = F.row_number().over(Window.partitionBy("band", "key").orderBy("cls"))
        large = members.where(f"size > {SMALL}").withColumn("place", rank).where(F.col("place") <= pivots).drop("place")  # a task passes on its first few
        heads = staged(members.where(f"size <= {SMALL}").unionByName(large), "heads")
        pairs = _alike(members, heads, classes.select("cls", "sig")).distinct()
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        new = staged(_links(pairs, found), "links")
        old += [pairs, new, heads]
        tried = tried.union(pairs)
        if new.limit(1).count():
            old.append(labels)
            labels = _joined(labels, new)
        members_now, pivots = members.join(heads.select("band", "key", "cls"), ["band", "key", "cls"], "left_anti"), pivots * MORE
    discard(members, found, links, *old)
    out = labels.withColumnsRenamed({"node": "cls"})
    out.staged_at = labels.staged_at
    return out


@columns_apart
def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row left of each group of near copies: the one with the least id, null ids last; of equal rows one.

    Texts link from a similarity of SIMILAR on; a group is all that links reach. Texts without words are one group.
    """
    rows = staged(_sketches(docs), "sketches")
    classes = staged(rows.groupBy("cls").agg(F.min_by(F.struct("row_key", "n", "fp", "bands", "sig"), "row_key").alias("c")).select("cls", "c.*"), "classes")
    labels = _compare(docs, classes)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    best = rows.groupBy("cls").agg(first.alias("f"))
    if labels is not None:
        best = best.join(labels, "cls", "left").groupBy(F.coalesce("label", "cls").alias("label")).agg(F.min("f").alias("f"))
    kept = staged(best.select(F.col("f.row_key").alias("_key")), "kept")
    discard(rows, classes, *([labels] if labels is not None else []))
    return docs.withColumn("_key", row_key()).dropDuplicates(["_key"]).join(kept, "_key", "left_semi").select(docs.columns)
