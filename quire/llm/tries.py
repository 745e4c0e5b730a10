"""The prefix trie of conversations in succinct level-order form (LOUDS), built shard by shard.

A turn is named by 128 bits of its role and text, a node by the exclusive or of its turns' hashes with their
depths: that sum can be taken in any order and in parts, so a conversation of any length is scanned in ranges.
Conversations of the same turns count as one with a weight. Nodes with many rows below them are heavy; what hangs
below a heavy node (or the root) by a light one is a shard, and shards share packs of bounded size. A task sorts a
pack into level order, where numpy makes the bitvector, finds parents by rank and select, and rolls totals up from
the last level with add.at. Heavy levels merge by grouping: each conversation brings the sums of what it is the
first member of to all its heavy nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import discard, staged

#: A node with more rows at and below it is heavy; a pack of shards holds less than twice as many rows.
HEAVY = 1 << 16
#: Depths of a conversation that are scanned in one piece.
RANGE = 1 << 16
#: Heavy nodes are broadcast up to so many, joined beyond.
FEW = 100_000
#: Ids of a piece of a node's list of ends.
CHUNK = 4096
EVERY, HEADS = 100, 6
_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def _turns(conversations: DataFrame) -> DataFrame:
    """Own turns, staged: (conv_id, part, n, x, y, size), numbered by turn (null first, equal turns by their hash).

    Rows are laid out in ranges of conversation and turn, numbered within a range, and moved on by what the ranges before
    hold of their conversation, so a conversation with very many turns is in many tasks.
    """
    role, said = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.xxhash64(role, said).alias("x"), F.xxhash64(F.lit(1), said, role).alias("y"), F.length(said).cast("long").alias("size"), F.monotonically_increasing_id().alias("at")
    )
    order = [F.asc_nulls_first("turn"), "x", "y", "at"]
    laid = staged(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    held = laid.groupBy("conv_id", "part").agg(F.count("*").alias("held"))
    start = F.coalesce(F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(*_BEFORE)), F.lit(0))
    starts = held.select("conv_id", "part", start.alias("start"))
    n = F.col("start") + F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    out = staged(laid.join(starts, ["conv_id", "part"]).select("conv_id", "part", n.alias("n"), "x", "y", "size"), "numbered")
    discard(laid)
    return out


def _lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, base, h, heads, length): of each conversation the one whose first turns it takes, how many of its own go, how many it gets, and its turns when rebuilt."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("m"))
    base = (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base")
    own = own.select("conv_id", "m", base, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    other = own.select(F.col("conv_id").alias("base"), F.least("m", F.lit(HEADS)).alias("there"))
    heads = F.least("h", F.coalesce("there", F.lit(0)))
    return own.join(other, "base", "left").select("conv_id", "base", "h", heads.alias("heads"), (heads + F.greatest(F.col("m") - F.col("h"), F.lit(0))).alias("length"))


def _hashes(d: str = "d") -> list[Column]:
    return [F.xxhash64(d, "x", "y").alias("hx"), F.xxhash64(F.lit(1), "y", "x", d).alias("hy")]


def _running(rows: DataFrame) -> DataFrame:
    """rows(conv_id, piece, d, hx, hy, size) with the name of the node (qx, qy): all hashes up to depth d, summed up within a piece of a conversation and moved on by the pieces before."""
    held = rows.groupBy("conv_id", "piece").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"))
    ahead = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(*_BEFORE)
    held = held.select("conv_id", "piece", *(F.coalesce(F.bit_xor(c).over(ahead), F.lit(0)).alias(c) for c in ("bx", "by")))
    here = Window.partitionBy("conv_id", "piece").orderBy("d").rowsBetween(*_UP_TO_HERE)
    q = [F.bit_xor(h).over(here).bitwiseXOR(F.col(b)).alias(q) for h, b, q in (("hx", "bx", "qx"), ("hy", "by", "qy"))]
    return rows.join(held, ["conv_id", "piece"]).select("conv_id", "d", "hx", "hy", "size", *q)


def paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: steps (conv_id, d, hx, hy, qx, qy, size), and ends (conv_id, length, ex, ey), the node each ends at; both staged.

    (qx, qy) names the node at depth d, and (qx ^ hx, qy ^ hy) its parent; the root is (0, 0).
    """
    turns = _turns(conversations)
    lengths = staged(_lengths(turns), "lengths")
    taken = turns.where((F.col("conv_id") % EVERY == 0) & (F.col("n") < HEADS)).select(F.col("conv_id").alias("base"), F.col("n").alias("d"), "x", "y", "size")
    heads = lengths.where("heads > 0").join(taken, "base").where("d <= heads").select("conv_id", "d", "size", *_hashes())
    own = turns.join(lengths.select("conv_id", "h", "heads"), "conv_id").where("n > h").withColumn("d", F.col("n") - F.col("h") + F.col("heads"))
    own = own.select("conv_id", F.floor(F.col("d") / RANGE).cast("long").alias("piece"), "d", "size", *_hashes())
    both = staged(heads.select("conv_id", F.lit(-1).cast("long").alias("piece"), "d", "size", "hx", "hy").unionByName(own), "rebuilt")
    discard(turns)
    steps = staged(_running(both), "steps")
    last = both.groupBy("conv_id").agg(F.bit_xor("hx").alias("ex"), F.bit_xor("hy").alias("ey"))
    ends = staged(lengths.select("conv_id", "length").join(last, "conv_id", "left").na.fill(0, ["ex", "ey"]), "ends")
    discard(both, lengths)
    return steps, ends


# -- packs of light shards ---------------------------------------------------------------------
class Louds:
    """A forest in level order: a bit per child and a zero after each node's children, those of a super-root first."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        ones = np.flatnonzero(bits)
        #: Parent of each node by its place in level order, -1 for a top: the zeros before its own bit close the nodes before its parent.
        self.parent = ones - np.arange(len(ones)) - 1
        zeros = np.flatnonzero(bits == 0)
        self.degree = np.diff(zeros) - 1
        self.tops = int(zeros[0])

    @classmethod
    def of(cls, parent: np.ndarray) -> Louds:
        degree = np.bincount(parent + 1, minlength=len(parent) + 1)
        bits = np.ones(int(degree.sum()) + len(degree), np.uint8)
        bits[np.cumsum(degree) + np.arange(len(degree))] = 0
        return cls(bits)

    def levels(self) -> list[tuple[int, int]]:
        """Where each level begins and ends."""
        out, lo, hi = [], 0, self.tops
        through = np.r_[0, np.cumsum(self.degree)]
        while lo < hi:
            out.append((lo, hi))
            lo, hi = hi, self.tops + int(through[hi])
        return out

    def rolled_up(self, own: np.ndarray) -> np.ndarray:
        """own summed over each node's subtree, itself included: level by level, the last first."""
        out = own.copy()
        for lo, hi in reversed(self.levels()[1:]):
            np.add.at(out, self.parent[lo:hi], out[lo:hi])
        return out

    def handed_down(self, tops: np.ndarray) -> np.ndarray:
        """A top's value for all nodes below it."""
        out = np.zeros(len(self.parent), tops.dtype)
        out[: self.tops] = tops
        for lo, hi in self.levels()[1:]:
            out[lo:hi] = out[self.parent[lo:hi]]
        return out


PACK = "bits binary, labels binary, above binary, depths binary, sizes binary, first binary, counts binary"
_STEP = ("tx", "ty", "td", "conv_id", "d", "hx", "hy", "qx", "qy", "size", "weight")


def _pack(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows of whole shards as one trie in level order; labels are the nodes' names, above those of the tops' parents."""
    qx, qy = rows["qx"], rows["qy"]
    px, py = qx ^ rows["hx"], qy ^ rows["hy"]
    n = len(qx)
    kx, ky = np.r_[qx, px], np.r_[qy, py]
    order = np.lexsort((ky, kx))
    name = np.empty(2 * n, np.int64)
    name[order] = np.cumsum(np.r_[False, (np.diff(kx[order]) != 0) | (np.diff(ky[order]) != 0)])
    at = np.argsort(name[:n], kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(name[:n][at]) != 0])
    pick = at[starts]  # a row of each node
    node_of = np.full(2 * n, -1)
    node_of[name[pick]] = np.arange(len(pick))
    parent = node_of[name[n:][pick]]
    level = rows["d"][pick] - rows["td"][pick]
    rank, place, ordered = np.full(len(pick), -1), 0, []
    by_level = np.argsort(level, kind="stable")
    for part in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        above = np.where(parent[part] >= 0, rank[parent[part]], -1)
        part = part[np.lexsort((qy[pick][part], qx[pick][part], above))]
        rank[part] = np.arange(place, place + len(part))
        place += len(part)
        ordered.append(part)
    order = np.concatenate(ordered)
    trie = Louds.of(np.where(parent[order] >= 0, rank[parent[order]], -1))
    row = pick[order]
    tops = row[: trie.tops]
    fields = {
        "bits": np.packbits(trie.bits), "labels": np.stack([qx[row], qy[row]]), "above": np.stack([px[tops], py[tops]]), "depths": rows["d"][tops], "sizes": rows["size"][row],
        "first": np.minimum.reduceat(rows["conv_id"][at], starts)[order], "counts": np.add.reduceat(rows["weight"][at], starts)[order],
    }
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in fields.values()], list(fields))


def tries(light: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Packs of light(tx, ty, td, conv_id, d, hx, hy, qx, qy, size, weight), whose shard (tx, ty) begins at depth td: a LOUDS bitvector and arrays in level order, as bytes."""

    def run(batches):
        held: list[dict] = []
        n = 0
        for b in batches:
            now = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(_STEP)}
            while len(now["d"]):
                if n < heavy:
                    cut = min(len(now["d"]), heavy - n)
                else:  # the pack is full once its last shard ends
                    last = held[-1]["tx"][-1], held[-1]["ty"][-1]
                    other = (now["tx"] != last[0]) | (now["ty"] != last[1])
                    cut = int(other.argmax()) if other.any() else len(other)
                    if not cut:
                        yield _pack({c: np.concatenate([h[c] for h in held]) for c in _STEP})
                        held, n = [], 0
                        continue
                held.append({c: v[:cut] for c, v in now.items()})
                n += cut
                now = {c: v[cut:] for c, v in now.items()}
        if n:
            yield _pack({c: np.concatenate([h[c] for h in held]) for c in _STEP})

    dealt = light.select(*_STEP).repartition("tx", "ty").sortWithinPartitions("tx", "ty")
    return dealt.mapInArrow(run, PACK)


NODE = "qx long, qy long, ax long, ay long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def rollups(packs: DataFrame) -> DataFrame:
    """A row per node of tries(): NODE, with (ax, ay) the name of a top's parent, and null below the tops."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                numbers = {c: np.frombuffer(r[c], np.int64) for c in ("labels", "above", "depths", "sizes", "first", "counts")}
                n = len(numbers["first"])
                bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
                trie = Louds(bits[: 2 * n + 1])
                level = np.repeat(np.arange(len(trie.levels())), [hi - lo for lo, hi in trie.levels()])
                below = trie.rolled_up((trie.degree == 0).astype(np.int64))
                saved = trie.rolled_up((numbers["counts"] - 1) * numbers["sizes"])
                lower = np.arange(n) >= trie.tops
                above = [pa.array(np.r_[x, np.zeros(n - trie.tops, np.int64)], mask=lower) for x in numbers["above"].reshape(2, -1)]
                parent = pa.array(np.where(lower, numbers["first"][trie.parent], 0), mask=~lower)
                qx, qy = numbers["labels"].reshape(2, -1)
                cells = [qx, qy, *above, numbers["first"], trie.handed_down(numbers["depths"]) + level, parent, numbers["counts"], trie.degree.astype(np.int64), below, saved]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cells], [f.split()[0] for f in NODE.split(", ")])

    return packs.mapInArrow(run, NODE)


# -- heavy levels, ends ------------------------------------------------------------------------
def _heavy_nodes(upper: DataFrame, tops: DataFrame) -> DataFrame:
    """Totals of heavy nodes, NODE, staged. upper(conv_id, d, hx, hy, qx, qy, size, weight): the heavy steps of all conversations; tops: the shards' tops, NODE.

    A node belongs to its smallest member, which brings what it has from any depth on to each of its heavy nodes; a shard's top counts at the step above it.
    """
    facts = upper.groupBy("qx", "qy").agg(F.min("conv_id").alias("first"), F.sum("weight").alias("n_convs"), F.max("size").alias("last"), F.max("d").alias("depth"), F.max(F.col("qx").bitwiseXOR(F.col("hx"))).alias("ax"), F.max(F.col("qy").bitwiseXOR(F.col("hy"))).alias("ay"))
    facts = staged(facts, "heavy-facts")
    own = facts.select(F.col("first").alias("conv_id"), F.col("depth").alias("d"), F.lit(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("last")).alias("saved"))
    hung = tops.where("depth > 1").select("conv_id", (F.col("depth") - 1).alias("d"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    brought = own.unionByName(hung).groupBy("conv_id", "d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    rows = upper.select("conv_id", "d", "qx", "qy").join(brought, ["conv_id", "d"], "left").na.fill(0, ["leaves", "saved"]).withColumn("piece", F.floor(F.col("d") / RANGE))
    later = Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(*_BEFORE)
    held = rows.groupBy("conv_id", "piece").agg(F.sum("leaves").alias("a"), F.sum("saved").alias("b"))
    held = held.select("conv_id", "piece", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in "ab"))
    here = Window.partitionBy("conv_id", "piece").orderBy(F.desc("d")).rowsBetween(*_UP_TO_HERE)
    rows = rows.join(held, ["conv_id", "piece"]).select("qx", "qy", (F.col("a") + F.sum("leaves").over(here)).alias("leaves"), (F.col("b") + F.sum("saved").over(here)).alias("saved"))
    totals = rows.groupBy("qx", "qy").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = facts.select("ax", "ay").unionByName(tops.select("ax", "ay")).groupBy(F.col("ax").alias("qx"), F.col("ay").alias("qy")).agg(F.count("*").alias("n_children"))
    out = facts.join(totals, ["qx", "qy"]).join(children, ["qx", "qy"])
    out = staged(out.select("qx", "qy", "ax", "ay", F.col("first").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"), "heavy-nodes")
    discard(facts)
    return out


_PIECE = (("qx", pa.int64()), ("qy", pa.int64()), ("least", pa.int64()), ("ids", pa.string()))
_HASH = (("qx", pa.int64()), ("qy", pa.int64()), ("ends_sha256", pa.string()))


def end_hashes(ends: DataFrame) -> DataFrame:
    """(qx, qy, ends_sha256) of nodes at which conversations end: SHA-256 of their ids in order, joined by commas.

    Ids are laid out in ranges and written in pieces of CHUNK ids; the task that hashes a node reads its pieces one after the other and holds one batch of them.
    """

    def cut(batches):
        node, held = None, []
        for b in batches:
            qx, qy, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.r_[True, (np.diff(qx) != 0) | (np.diff(qy) != 0)][: len(ids)])
            out = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                now = (int(qx[lo]), int(qy[lo]))
                if now != node:
                    if held:
                        out.append((*node, held[0], ",".join(map(str, held))))
                    node, held = now, []
                held += ids[lo:hi].tolist()
                while len(held) > CHUNK:
                    out.append((*node, held[0], ",".join(map(str, held[:CHUNK]))))
                    held = held[CHUNK:]
            yield made(out, _PIECE)
        if held:
            yield made([(*node, held[0], ",".join(map(str, held)))], _PIECE)

    def hashed(batches):
        now, h = None, None
        for b in batches:
            out = []
            for x, y, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (x, y) != now:
                    if now:
                        out.append((*now, h.hexdigest()))
                    now, h = (x, y), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield made(out, _HASH)
        if now:
            yield made([(*now, h.hexdigest())], _HASH)

    def made(rows, fields):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])

    order = ["qx", "qy", "conv_id"]
    rows = ends.select(F.col("ex").alias("qx"), F.col("ey").alias("qy"), "conv_id")
    pieces = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "qx long, qy long, least long, ids string")
    return pieces.repartition("qx", "qy").sortWithinPartitions("qx", "qy", "least").mapInArrow(hashed, "qx long, qy long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, heavy: int = HEAVY, few: int = FEW) -> DataFrame:
    """A row per distinct sequence of first turns of the rebuilt conversations, the root included: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conv_id c - c % 100 lends its first h turns, h = crc32(c) % 6, to c; % leaves the sign of c. Rows without a conv_id take no part;
    a null role or text is empty; turns of equal number are taken in order of the hash of role and text, repeated rows are
    turns of their own. No rows give no root. Columns but conv_id, turn, role and text are not read.
    """
    steps, ends = paths(conversations)
    same = staged(ends.groupBy("ex", "ey").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("length").alias("length")), "same")
    walked = staged(steps.join(same.select("conv_id", "weight", "length"), "conv_id"), "walked")
    discard(steps, same)
    rows = walked.groupBy("qx", "qy").agg(F.sum(F.col("length") - F.col("d") + 1).alias("rows"))
    marks = staged(rows.where(F.col("rows") > heavy).select("qx", "qy", F.lit(True).alias("heavy")), "heavy")
    marked = walked.join(F.broadcast(marks) if marks.limit(few + 1).count() <= few else marks, ["qx", "qy"], "left")
    upper, light = marked.where("heavy"), marked.where("heavy is null")
    shard = light.groupBy("conv_id").agg(F.min("d").alias("td"), F.min_by("qx", "d").alias("tx"), F.min_by("qy", "d").alias("ty"))
    packs = tries(light.join(shard, "conv_id"), heavy)
    lower = staged(rollups(packs), "light-nodes")
    tops, inside = lower.where("ax is not null"), lower.where("ax is null")
    above = _heavy_nodes(upper, tops)
    discard(walked, marks)
    none, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    counted = ends.select("conv_id", F.lit(1).alias("n"), none.alias("child"), none.alias("n_leaves"), none.alias("saved_tokens"))
    hung = tops.unionByName(above).where("depth = 1").select(null.alias("conv_id"), F.lit(0).alias("n"), F.lit(1).alias("child"), "n_leaves", "saved_tokens")
    root = counted.unionByName(hung).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = root.where("n_convs > 0").select(none.alias("qx"), none.alias("qy"), null.alias("ax"), null.alias("ay"), "conv_id", none.alias("depth"), null.alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")
    root = staged(root, "root")
    parents = above.unionByName(root).select(F.col("qx").alias("ax"), F.col("qy").alias("ay"), F.col("conv_id").alias("up"))
    joined = tops.unionByName(above).join(parents, ["ax", "ay"]).withColumn("parent_conv_id", F.col("up")).drop("up")
    nodes = inside.unionByName(joined).unionByName(root).join(end_hashes(ends), ["qx", "qy"], "left")
    hashed = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", hashed)
