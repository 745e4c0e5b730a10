"""Chroma audio fingerprints of a media column, and their alignment.

Sound is cut into overlapping frames; the energy of each of twelve pitch classes per frame makes an
image. Sixteen filters compare sums of rectangles of that image, read from its integral, at each
frame; two bits from each, Gray-coded, are packed into one 32-bit integer. Recordings that share runs of
integers are aligned by the histogram of the offsets at which they do, and judged by the share of
differing bits over the whole overlap at the best offset.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pieces, staged

FRAME, HOP, RATE = 256, 64, 8000
LOWEST, HIGHEST = 60.0, 3600.0
#: Frames a filter sees.
SPAN = 12
#: Shared keys at one offset that make a candidate, share of differing bits up to which it is a match, least overlap in frames and as a share of the shorter.
LEAST_HITS, MOST_ERROR, LEAST_OVERLAP, LEAST_SHARE = 3, 0.2, 8, 0.6
#: Frames of a block of queries, about: what a task holds; frames of a group of recordings that pass it.
BLOCK_FRAMES, GROUP_FRAMES = 1 << 20, 1 << 23


def _fold() -> np.ndarray:
    """Spectrum bins to pitch classes, the twelve semitones of the octave."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    m = np.zeros((len(hertz), 12), np.float32)
    use = (hertz >= LOWEST) & (hertz <= HIGHEST)
    m[np.flatnonzero(use), np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12] = 1
    return m


_PITCH = _fold()
_WINDOW = np.hanning(FRAME).astype(np.float32)
#: (kind, first class, classes, frames): halves over time, halves over pitch, quarters, middle against sides.
FILTERS = [(k % 4, (5 * k) % 9, 2 + k % 3, (4, 8, 12)[k % 3]) for k in range(16)]


def pitch_frames(sound: np.ndarray) -> np.ndarray:
    """Frames by pitch class, each frame of unit length; fewer samples than a frame are filled with silence."""
    x = sound.astype(np.float32)
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), 12), np.float32)
    for at in range(0, len(frames), 2048):
        some = frames[at : at + 2048]
        spectrum = np.fft.rfft((some - some.mean(1, keepdims=True)) * _WINDOW, axis=1)
        out[at : at + 2048] = np.abs(spectrum).astype(np.float32) @ _PITCH
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-6)


def fingerprint(sound: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each frame from which SPAN frames follow; empty for empty sound, one integer for short sound."""
    if not len(sound):
        return np.zeros(0, np.uint32)
    frames = pitch_frames(sound)
    if len(frames) < SPAN:
        frames = np.concatenate([frames, np.repeat(frames[-1:], SPAN - len(frames), axis=0)])
    whole = np.zeros((len(frames) + 1, 13))
    whole[1:, 1:] = frames.cumsum(0, dtype=np.float64).cumsum(1)
    n = len(frames) - SPAN + 1
    at = np.arange(n)

    def box(t0, t1, p0, p1):
        return whole[at + t1, p1] - whole[at + t0, p1] - whole[at + t1, p0] + whole[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for k, (kind, p, tall, wide) in enumerate(FILTERS):
        q, half, mid = min(12, p + tall), wide // 2, p + max(1, min(12 - p, tall) // 2)
        if kind == 0:
            a, b = box(0, half, p, q), box(half, wide, p, q)
        elif kind == 1:
            a, b = box(0, wide, p, mid), box(0, wide, mid, q)
        elif kind == 2:
            a, b = box(0, half, p, mid) + box(half, wide, mid, q), box(half, wide, p, mid) + box(0, half, mid, q)
        else:
            third = max(1, wide // 3)
            a, b = 2 * box(third, wide - third, p, q), box(0, third, p, q) + box(wide - third, wide, p, q)
        change = np.log((1 + a) / (1 + b))
        level = (change > -0.2).astype(np.uint32) + (change > 0) + (change > 0.2)
        out |= (level ^ (level >> 1)) << np.uint32(2 * k)
    return out


def fingerprints(media: DataFrame, key: str = "doc_id", column: str = "audio") -> DataFrame:
    """(rec_id, n_frames, fp) of every row; column holds unsigned 8-bit mono sound as bytes, null counting as empty; fp is little-endian uint32."""

    def run(batches):
        for b in pieces(batches, 1 << 20):
            found = [fingerprint(np.frombuffer(x or b"", np.uint8)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([f.astype("<u4").tobytes() for f in found], pa.binary())], ["rec_id", "n_frames", "fp"])

    return media.select(F.col(key).cast("long"), F.col(column).cast("binary")).mapInArrow(run, "rec_id long, n_frames long, fp binary")


def occurrences(prints: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """All pairs of neighbouring integers: (key, owner, start, count) of each distinct one of an owner, and frames, which starts and counts point into."""
    keys_, owner, start, count, frames, at = [np.zeros(0, np.uint64)], [], [], [], [np.zeros(0, np.int64)], 0
    for i, fp in enumerate(prints):
        if len(fp) < 2:
            continue
        pair = fp[:-1].astype(np.uint64) << np.uint64(32) | fp[1:]
        order = np.argsort(pair, kind="stable")
        k, first, n = np.unique(pair[order], return_index=True, return_counts=True)
        keys_.append(k)
        owner.append(np.full(len(k), i))
        start.append(first + at)
        count.append(n)
        frames.append(order)
        at += len(order)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(keys_), *(np.concatenate(none + x) for x in (owner, start, count)), np.concatenate(frames)


class Index:
    """Queries' distinct keys, sorted, each with query and all its frames."""

    def __init__(self, prints: list[np.ndarray]):
        self.prints = prints
        key, query, start, count, self.frames = occurrences(prints)
        order = np.argsort(key, kind="stable")
        self.key, self.query, self.start, self.count = key[order], query[order], start[order], count[order]

    def candidates(self, recordings: list[np.ndarray], most: int = 1 << 20):
        """Yields (recording, query, offset) arrays: every offset at which LEAST_HITS pairs of occurrences of shared keys agree.

        Votes are expanded in blocks of about `most`; a pair of recordings with more than `most` votes of its own counts them by correlation.
        """
        key, rec, start, count, frames = occurrences(recordings)
        low = np.searchsorted(self.key, key, side="left")
        size = np.searchsorted(self.key, key, side="right") - low
        per_rec = np.bincount(rec, weights=size, minlength=len(recordings))
        part = (np.cumsum(per_rec) // most).astype(np.int64)  # recordings whose shared keys are handled together
        for p in np.unique(part).tolist():
            some = np.flatnonzero((part[rec] == p) & (size > 0))
            if not len(some):
                continue
            n = size[some]
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
            i = np.repeat(some, n)
            order = np.lexsort((self.query[j], rec[i]))
            i, j = i[order], j[order]
            r, q, votes = rec[i], self.query[j], count[i] * self.count[j]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (q[1:] != q[:-1])])
            total = np.add.reduceat(votes, first)
            for f in first[total > most].tolist():
                hits, least = _hits(recordings[r[f]], self.prints[q[f]])
                offset = np.flatnonzero(hits >= LEAST_HITS) + least
                yield np.full(len(offset), r[f]), np.full(len(offset), q[f]), offset
            light = (total >= LEAST_HITS) & (total <= most)
            block = np.cumsum(np.where(light, total, 0)) // most
            span = np.diff(np.r_[first, len(r)])
            light, block = np.repeat(light, span), np.repeat(block, span)
            for b in np.unique(block[light]).tolist():
                at = np.flatnonzero(light & (block == b))
                yield self._offsets(r[at], q[at], start[i[at]], frames, self.start[j[at]], self.count[j[at]], votes[at])

    def _offsets(self, r, q, start, frames, own_start, own_count, votes):
        v = np.arange(votes.sum()) - np.repeat(np.cumsum(votes) - votes, votes)
        wide = np.repeat(own_count, votes)
        offset = frames[np.repeat(start, votes) + v // wide] - self.frames[np.repeat(own_start, votes) + v % wide]
        r, q = np.repeat(r, votes), np.repeat(q, votes)
        order = np.lexsort((offset, q, r))
        r, q, offset = r[order], q[order], offset[order]
        first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (q[1:] != q[:-1]) | (offset[1:] != offset[:-1])])
        first = first[np.diff(np.r_[first, len(r)]) >= LEAST_HITS]
        return r[first], q[first], offset[first]


def _hits(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Agreeing keys of two recordings at every offset, and the least offset; a shared key at a time, by correlation where it is frequent."""
    (ka, _, sa, ca, fa), (kb, _, sb, cb, fb) = occurrences([a]), occurrences([b])
    n, least = len(a) + len(b), 1 - len(b)
    hits = np.zeros(n, np.int64)
    _, x, y = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    for i, j in zip(x.tolist(), y.tolist()):
        at, own = fa[sa[i] : sa[i] + ca[i]], fb[sb[j] : sb[j] + cb[j]]
        if len(at) * len(own) <= 1 << 16:
            hits += np.bincount((at[:, None] - own).ravel() - least, minlength=n)
            continue
        u, w = np.bincount(at, minlength=len(a)), np.bincount(len(b) - 1 - own, minlength=len(b))
        hits += np.rint(np.fft.irfft(np.fft.rfft(u, n) * np.fft.rfft(w, n), n)).astype(np.int64)
    return hits, least


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits over the frames where a, moved back by offset, and b overlap; and how many frames that are."""
    first, last = max(0, -offset), min(len(b), len(a) - offset)
    n = last - first
    if n <= 0:
        return 1.0, 0
    return float(np.bitwise_count(a[first + offset : last + offset] ^ b[first:last]).sum()) / (32 * n), n


def classes_of(prints: DataFrame, every: int) -> DataFrame:
    """Distinct fingerprints that are not empty: h1, h2 (128 bits that name one), fp, n_frames, n (rows), none and id (the least id, null last), asked (whether a query has it), staged."""
    rows = prints.where("n_frames > 0").select(*_name(), "rec_id", "n_frames", "fp")
    who = F.min(F.struct(F.col("rec_id").isNull().alias("none"), F.col("rec_id").alias("id")))
    asked = F.max(F.coalesce(F.col("rec_id") % every == 0, F.lit(False)))
    found = rows.groupBy("h1", "h2").agg(F.first("fp").alias("fp"), F.first("n_frames").alias("n_frames"), F.count("*").alias("n"), who.alias("who"), asked.alias("asked"))
    return staged(found.select("h1", "h2", "fp", "n_frames", "n", "who.none", "who.id", "asked"), "classes")


def _name() -> list[F.Column]:
    return [F.xxhash64("fp").alias("h1"), F.xxhash64(F.lit(1), "fp").alias("h2")]


def _cell_rows(batches):
    """Rows (cell, kind, h1, h2, fp, n, none, id) sorted by cell and kind, a cell's queries (kind 0) before its recordings: each query's links in the cell, summed."""
    now, names, data, index, found = None, [], [], None, {}

    def flush():
        at = sorted(found)
        cols = [[names[q][0] for q in at], [names[q][1] for q in at], [found[q][0] for q in at], [found[q][1][1] for q in at], [None if found[q][1][1] else found[q][1][2] for q in at], [found[q][1][3] for q in at], [found[q][1][0] for q in at]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h1", "h2", "n", "none", "id", "offset", "error"])

    for b in pieces(batches, 1 << 19, 4):
        cells, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
        starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])])
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]):
            if cells[at] != now:
                if found:
                    yield flush()
                now, names, data, index, found = cells[at], [], [], None, {}
            part = b.slice(at, end - at)
            who = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist()))
            prints = [np.frombuffer(x, "<u4") for x in part.column(4).to_pylist()]
            if kinds[at] == 0:
                names += who
                data += prints
            elif data:
                index = index or Index(data)
                _link(index, names, who, prints, part.column(5).to_pylist(), part.column(6).to_pylist(), part.column(7).to_pylist(), found)
    if found:
        yield flush()


def _link(index: Index, names: list, who: list, prints: list[np.ndarray], n: list[int], none: list[bool], ids: list[int | None], found: dict) -> None:
    """Adds to found, by query, the rows of the recordings that align with it, and the best: least error, then least id, null last."""
    size, lens = np.array([len(d) for d in index.prints]), np.array([len(x) for x in prints])
    for rs, qs, offsets in index.candidates(prints):
        over = np.minimum(size[qs], lens[rs] - offsets) - np.maximum(0, -offsets)
        wide = over >= np.maximum(LEAST_OVERLAP, LEAST_SHARE * np.minimum(lens[rs], size[qs]))
        linked: dict[tuple, tuple] = {}
        for r, q, o in zip(rs[wide].tolist(), qs[wide].tolist(), offsets[wide].tolist(), strict=True):
            if who[r] == names[q]:  # rows of one fingerprint are counted apart
                continue
            error, _ = bit_error(prints[r], index.prints[q], o)
            if error <= MOST_ERROR and ((r, q) not in linked or (error, abs(o), o) < linked[r, q]):
                linked[r, q] = (error, abs(o), o)
        for (r, q), (error, _, o) in linked.items():  # a pair's offsets come in one block
            best = (error, none[r], ids[r] or 0, o)
            count, known = found.get(q, (0, best))
            found[q] = (count + n[r], min(best, known))


def search(prints: DataFrame, every: int = 20, block_frames: int = BLOCK_FRAMES, group_frames: int = GROUP_FRAMES) -> DataFrame:
    """One row per query, a recording whose id is divisible by `every`: rec_id, n_frames, n_links, best_id, best_offset, best_error.

    A link is another recording that aligns: enough shared keys at one offset, few differing bits over an
    overlap of enough frames. best is the link with least error, then least id. Equal fingerprints of any length, but the
    empty one, are links at offset 0 if their ids differ; rows of one id but different sound are queries, and links of each other.
    Queries without links have n_links 0. Null ids are no queries but may be found.

    Recordings of one fingerprint are compared once. Blocks of queries meet groups of recordings in cells, dealt by a shuffle; the driver
    sees sums of frames. A cell passes on a row per query at most.
    """
    prints = staged(prints, "prints")
    classes = classes_of(prints, every)
    frames = classes.where(f"n_frames >= {LEAST_OVERLAP}").agg(F.sum(F.when(F.col("asked"), F.col("n_frames"))), F.sum("n_frames"), F.count("*")).first()
    blocks = max(1, -(-(frames[0] or 0) // block_frames))
    groups = max(1, -(-(frames[1] or 0) // group_frames), min(frames[2], -(-4 * prints.sparkSession.sparkContext.defaultParallelism // blocks)))
    each = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long")))
    long_ = classes.where(f"n_frames >= {LEAST_OVERLAP}")
    asked = long_.where("asked").withColumn("kind", F.lit(0)).withColumn("a", F.pmod("h1", F.lit(blocks))).withColumn("b", each(groups))
    given = long_.withColumn("kind", F.lit(1)).withColumn("b", F.pmod("h2", F.lit(groups))).withColumn("a", each(blocks))
    cells = asked.unionByName(given).withColumn("cell", F.col("a") * groups + F.col("b")).select("cell", "kind", "h1", "h2", "fp", "n", "none", "id")
    found = cells.repartition(blocks * groups, "cell").sortWithinPartitions("cell", "kind").mapInArrow(_cell_rows, "h1 long, h2 long, n long, none boolean, id long, offset long, error double")
    best = F.min(F.struct("error", "none", "id", "offset"))
    links = staged(found.groupBy("h1", "h2").agg(F.sum("n").alias("n"), best.alias("b")), "links")
    wanted = prints.where(F.col("rec_id") % every == 0).select("rec_id", "n_frames", *_name())
    rows = wanted.join(links, ["h1", "h2"], "left").join(_equal(prints, every), ["h1", "h2", "rec_id"], "left")
    zero = F.lit(0).cast("long")
    top = F.least("b", F.when(F.col("same") > 0, F.struct(F.lit(0.0).alias("error"), F.col("other.none").alias("none"), F.col("other.id").alias("id"), zero.alias("offset"))))
    return rows.select("rec_id", "n_frames", (F.coalesce("n", zero) + F.coalesce("same", zero)).alias("n_links"), top.getField("id").alias("best_id"), top.getField("offset").alias("best_offset"), top.getField("error").alias("best_error"))


def _equal(prints: DataFrame, every: int) -> DataFrame:
    """(h1, h2, rec_id, same, other): for queries, how many rows of other ids have the fingerprint, and the least of their ids, null last; counted by fingerprint, never paired."""
    who = F.struct(F.col("rec_id").isNull().alias("none"), F.col("rec_id").alias("id"))
    ids = staged(prints.where("n_frames > 0").select(*_name(), "rec_id").groupBy("h1", "h2", "rec_id").agg(F.count("*").alias("own")), "equal")
    tops = ids.groupBy("h1", "h2").agg(F.sum("own").alias("total"), F.min(who).alias("a"), F.count("*").alias("size")).where("size > 1")
    second = ids.join(tops.select("h1", "h2", "a"), ["h1", "h2"]).where(~who.eqNullSafe(F.col("a"))).groupBy("h1", "h2").agg(F.min(who).alias("b"))
    rows = ids.where(F.col("rec_id") % every == 0).join(tops, ["h1", "h2"]).join(second, ["h1", "h2"])
    other = F.when(F.col("a.id").eqNullSafe(F.col("rec_id")), F.col("b")).otherwise(F.col("a"))
    return rows.select("h1", "h2", "rec_id", (F.col("total") - F.col("own")).alias("same"), other.alias("other"))
