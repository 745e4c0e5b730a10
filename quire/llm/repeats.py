"""Repeated passages by enhanced suffix arrays over anchored contexts.

A text is a sequence of symbols, its bytes or its words. Two equal strings of `length` symbols select the
same anchors: positions whose hash of the next `anchor` symbols is least in some window of `length`. So
each repeat is found among the occurrences of one anchor, in their contexts: as many symbols to either
side as a string of that length can reach. Equal contexts are counted with map-side minima and stand for
one suffix, a leaf with several places. Per anchor the distinct contexts are sorted into a suffix array, neighbours' common
prefixes are scanned with a stack into the tree of common-prefix intervals, and within an interval the
symbols to the left are scanned the same way: where left extensions differ the group is a maximal repeat
(within its contexts), all its members are its occurrences, and they are what is covered.

An anchor with more than `HOT` distinct contexts is never gathered: its contexts are split into
slices of the window starts they stand for, each keyed by all the bytes its windows share, and the
slices are grouped afresh; slices of one window are equal or different as a whole and need only counts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, columns_apart, discard, pieces, staged, texts

LENGTH = 400
ANCHOR = 128
#: The same in words, for passages of over 50 words.
WORDS, WORD_ANCHOR = 51, 16
#: Contexts of an anchor that one task sorts.
HOT = 512
#: Window starts a slice stands for: all that see an anchor, then these.
SLICES = (16, 1)
BLOCK = 1 << 20

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29), np.uint64(32))


def _table() -> np.ndarray:
    return np.random.default_rng(400).integers(1, 2**63, 256, dtype=np.uint64)


_LETTER = _table()


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two neighbouring strings from theirs."""
    x = a * _MIX[0]
    x += b
    x ^= x >> _MIX[2]
    x *= _MIX[1]
    x ^= x >> _MIX[3]
    return x


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of `width` symbols, a power of two."""
    h, k = _LETTER[data] if data.dtype == np.uint8 else data, 1
    while k < width:
        h = _join(h[:-k], h[k:])
        k *= 2
    return h


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    k = 1
    while 2 * k <= width:
        x = pick(x[:-k], x[k:])
        k *= 2
    return pick(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def anchors(docs: list[np.ndarray], length: int, anchor: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text, given as its symbols, the positions of its anchors and their hashes; every string of `length` symbols holds one."""
    span = length - anchor + 1
    out: list[list] = [[] for _ in docs]
    parts: list[tuple[int, int, int]] = []  # text, first symbol, symbols

    def flush():
        if not parts:
            return
        data = np.concatenate([docs[i][a : a + n] for i, a, n in parts])
        ends = np.cumsum([n for _, _, n in parts])
        h = gram_hashes(data, anchor)
        low = _sliding(h, span, np.minimum)
        for e in ends[:-1].tolist():  # windows that cross from one text into the next select nothing
            low[max(0, e - length + 1) : e] = 0
        edge = np.zeros(span - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), span, np.maximum) == h)
        which = np.searchsorted(ends, at, side="right")
        starts = ends - np.array([n for _, _, n in parts])
        cut = np.searchsorted(which, np.arange(len(parts) + 1))
        for p, (i, a, _) in enumerate(parts):
            s = slice(cut[p], cut[p + 1])
            out[i].append((at[s] - starts[p] + a, h[at[s]]))
        parts.clear()

    held = 0
    for i, d in enumerate(docs):
        for a in range(0, len(d) - length + 1, BLOCK):
            n = min(len(d) - a, BLOCK + length - 1)
            parts.append((i, a, n))
            held += n
            if held >= BLOCK:
                flush()
                held = 0
    flush()
    done = []
    for found in out:
        at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        h = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
        if len(found) > 1:
            at, first = np.unique(at, return_index=True)
            h = h[first]
        done.append((at, h))
    return done


def symbols(text: bytes, wide: int) -> bytes:
    """The text as equal symbols: its bytes (wide = 1), or its words as hashes of 8 bytes."""
    if wide == 1:
        return text
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in text.split()], "<u8").tobytes()


def _numbers(x: bytes, wide: int) -> np.ndarray:
    return np.frombuffer(x, np.uint8 if wide == 1 else "<u8")


class Contexts:
    """Contexts (pivot c, span s): the windows of `length` symbols that start from c - s to c. Their core, [c, c + length - s), is in all of them."""

    def __init__(self, length: int, wide: int):
        self.length, self.wide = length, wide

    def digests(self, text: bytes, at: list[int], s: int) -> bytes:
        """128 bits for each context: its symbols and where its pivot lies in them."""
        n, length, w, h = len(text) // self.wide, self.length, self.wide, xxhash.xxh3_128_digest
        return b"".join([h(text[max(0, c - s) * w : min(n, c + length) * w], min(c, s)) for c in at])

    def exists(self, n: int, c: int, s: int) -> bool:
        return max(0, c - s) <= min(c, n - self.length)

    def core(self, text: bytes, c: int, s: int) -> int:
        x = xxhash.xxh3_64_intdigest(text[c * self.wide : (c + self.length - s) * self.wide], 1 << 32 | s)
        return x - (1 << 64) if x >= 1 << 63 else x


#: key: hash of the anchor; ctx, ctx2: of the context; rid: of the row; t1, t2: of its text; at: pivot c and span s of
#: the context, in symbols, and many, whether it is known to be in several texts, as c << 32 | s << 1 | many, since these rows are what is shuffled.
ROWS = "key long, ctx long, ctx2 long, rid long, t1 long, t2 long, at long"
TEXT = ("rid", "t1", "t2")


def _rows(key: np.ndarray, digests: bytes, names: list[tuple], each: list[int], c: np.ndarray, s: np.ndarray, many: list[bool]) -> pa.RecordBatch:
    ctx = np.frombuffer(digests, "<i8").reshape(-1, 2)
    who = np.repeat(np.array(names, np.int64).reshape(-1, 3), each, axis=0)
    at = c.astype(np.int64) << 32 | s.astype(np.int64) << 1 | np.asarray(many, np.int64)
    cols = [key, ctx[:, 0], ctx[:, 1], who[:, 0], who[:, 1], who[:, 2], at]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "ctx", "ctx2", *TEXT, "at"])


def _names(b: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(b.column(i).to_pylist() for i in range(3))))


def anchor_rows(found: DataFrame, length: int, anchor: int, wide: int) -> DataFrame:
    """A row for each anchor of each text (rid, t1, t2, text)."""

    def run(batches):
        ctx, s = Contexts(length, wide), length - anchor
        for b in pieces(batches, 1 << 20, 3):
            docs = [symbols(t, wide) for t in texts(b.column(3))]
            at, h = zip(*anchors([_numbers(d, wide) for d in docs], length, anchor))
            each = [len(x) for x in at]
            spans, many = np.full(sum(each), s), np.zeros(sum(each), bool)
            yield _rows(np.concatenate(h).view(np.int64), b"".join(ctx.digests(d, x.tolist(), s) for d, x in zip(docs, at)), _names(b), each, np.concatenate(at), spans, many)

    return found.select(*TEXT, "text").mapInArrow(run, ROWS)


def slice_rows(hot: DataFrame, found: DataFrame, length: int, width: int, wide: int) -> DataFrame:
    """The contexts of hot anchors cut into slices of `width` window starts, keyed by what a slice's windows share."""

    def run(batches):
        ctx = Contexts(length, wide)
        for b in pieces(batches, 1 << 18, 3):
            for name, t, todo in zip(_names(b), texts(b.column(3)), b.column(4).to_pylist(), strict=True):
                d = symbols(t, wide)
                n = len(d) // wide
                cut = [(x["c"] - off, min(width - 1, x["s"] - off), x["many"]) for x in todo for off in range(0, x["s"] + 1, width)]
                cut = [x for x in cut if x[0] >= 0 and ctx.exists(n, *x[:2])]
                for at in range(0, len(cut), 4096):
                    some = cut[at : at + 4096]
                    key = np.array([ctx.core(d, c, s) for c, s, _ in some], np.int64)
                    c, s, many = (np.array(x) for x in zip(*some))
                    yield _rows(key, b"".join(ctx.digests(d, [x], y) for x, y, _ in some), [name], [len(some)], c, s, many)

    todo = hot.groupBy(*TEXT).agg(F.collect_list(F.struct("c", "s", "many")).alias("todo"))
    return found.join(todo, [*TEXT]).select(*TEXT, "text", "todo").mapInArrow(run, ROWS)


# -- the enhanced suffix array ------------------------------------------------------------------
def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    m = np.zeros((len(strings), max(1, width)), np.uint8)
    m[np.arange(m.shape[1]) < size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return m, size


def _in_order(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of padded rows in the order of their bytes, the shorter first: padding and NUL bytes compare alike."""
    return np.lexsort((size, np.ascontiguousarray(m).view(f"S{m.shape[1]}").ravel()))


def _common(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows, in bytes."""
    differ = a != b
    first = differ.argmax(1)
    first[~differ[np.arange(len(first)), first]] = a.shape[1]
    return np.minimum(first, np.minimum(size_a, size_b))


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """Scans common prefixes of neighbours (lcp[i] of suffixes i and i + 1) with a stack: (length, first, last) of every interval of the tree, children before parents."""
    out, stack = [], []
    for i, v in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > v:
            length, first = stack.pop()
            if length >= least:
                out.append((length, first, i))
        if v and (not stack or stack[-1][0] < v):
            stack.append((v, first))
    return out


class SuffixArray:
    """Suffixes that start at the pivots of contexts, keyed; left holds the symbols before a pivot, nearest first. Lengths are in symbols of `wide` bytes."""

    def __init__(self, key: np.ndarray, left: list[bytes], right: list[bytes], length: int, wide: int = 1):
        self.length, self.wide, self.ladder = length, wide, None
        m, size = _matrix(right, length * wide)
        keyed = np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), m], axis=1)
        self.order = _in_order(keyed, size)
        m, size, key = m[self.order], size[self.order], key[self.order]
        self.lcp = _common(m[1:], m[:-1], size[1:], size[:-1]) // wide if len(m) > 1 else np.zeros(0, np.int64)
        self.lcp[key[1:] != key[:-1]] = 0
        left = [left[i] for i in self.order.tolist()]
        self.left, self.left_size = _matrix(left, max(map(len, left), default=1))
        self.left_rank = np.empty(len(left), np.int64)
        self.left_rank[_in_order(self.left, self.left_size)] = np.arange(len(left))

    def tree(self, most: int = 1 << 16):
        """Yields, for some intervals at a time: interval number, its length, member (place in the suffix array),
        and how far the member's left side agrees with the member before it, members sorted by left side (-1: the first)."""
        found = intervals(self.lcp.tolist(), 1)
        at = 0
        while at < len(found):
            part, held = [], 0
            while at < len(found) and (not part or held + found[at][2] - found[at][1] < most):
                part.append(found[at])
                held += found[at][2] - found[at][1] + 1
                at += 1
            length, first, last = np.array(part, dtype=np.int64).T
            size = last - first + 1
            own = np.repeat(np.arange(len(part)), size)
            member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[own]
            by_left = np.argsort(own * (len(self.left) + 1) + self.left_rank[member], kind="stable")
            member = member[by_left]
            agree = np.zeros(len(member), np.int64)
            for lo in range(1, len(member), 1 << 14):
                hi = min(len(member), lo + (1 << 14))
                a, b = member[lo:hi], member[lo - 1 : hi - 1]
                agree[lo:hi] = _common(self.left[a], self.left[b], self.left_size[a], self.left_size[b]) // self.wide
            agree[np.r_[True, own[1:] != own[:-1]]] = -1
            yield own, length[own], member, agree

    def found(self, least: int | None = None, most: int = 1 << 20):
        """Yields tables of maximal repeats: left, right of each; number of the repeat and place in the suffix array of each occurrence."""
        least = least or self.length
        for own, v, member, agree in self.tree():
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            size = np.diff(np.r_[starts, len(own)])
            some = np.unique(own[(agree >= 0) & (agree + v >= least)])  # in the other intervals no two left sides agree far enough
            at = starts[some[size[some] == 2]]  # two members: the group is the interval
            if len(at):
                yield agree[at + 1], v[at], np.repeat(np.arange(len(at)), 2), np.stack([member[at], member[at + 1]], axis=1).ravel()
            lows, firsts, lasts = [], [], []
            ahead, need = (agree + 1).tolist(), np.maximum(1, least - v + 1).tolist()
            for i in some[size[some] > 2].tolist():
                a, z = int(starts[i]), int(starts[i] + size[i])
                for low, first, last in intervals(ahead[a + 1 : z], need[a]):
                    lows.append(low - 1)
                    firsts.append(a + first)
                    lasts.append(a + last)
            low, first, last = np.array(lows, np.int64), np.array(firsts, np.int64), np.array(lasts, np.int64)
            block = np.cumsum(last - first + 1) // most
            for lo, hi in zip(*(np.searchsorted(block, np.unique(block), side=x).tolist() for x in ("left", "right"))):
                n = last[lo:hi] - first[lo:hi] + 1
                begin = np.cumsum(n) - n
                number = np.repeat(np.arange(hi - lo), n)
                place = member[np.arange(n.sum()) - begin[number] + first[lo:hi][number]]
                length = v[first[lo:hi]]
                # a part of an interval may go on alike to the right; then a longer interval has it
                ok = self.lowest(np.minimum.reduceat(place, begin), np.maximum.reduceat(place, begin)) == length
                yield low[lo:hi][ok], length[ok], (np.cumsum(ok) - 1)[number[ok[number]]], place[ok[number]]

    def lowest(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least common prefix of neighbours between places first < last."""
        if self.ladder is None:
            self.ladder = [self.lcp]
            while 2 ** len(self.ladder) <= len(self.lcp):
                x, k = self.ladder[-1], 2 ** (len(self.ladder) - 1)
                self.ladder.append(np.minimum(x[:-k], x[k:]))
        step = np.frexp((last - first).astype(float))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(step).tolist():
            at = step == k
            out[at] = np.minimum(self.ladder[k][first[at]], self.ladder[k][last[at] - (1 << k)])
        return out

    def groups(self, least: int | None = None):
        """Yields (left, right, members in input order) of each maximal repeat: members agree `left` symbols before
        and `right` after the pivot, some differ in the symbol before that, and some in the one after. least: their least length, self.length unless given."""
        for left, right, number, place in self.found(least):
            for i, who in enumerate(np.split(place, np.flatnonzero(np.diff(number)) + 1) if len(place) else []):
                yield int(left[i]), int(right[i]), np.sort(self.order[who])

    def reach(self, text: np.ndarray | None = None, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each context, in input order, how far left and right of its pivot the maximal repeats go that it is an occurrence of (-1: of none).

        text: whose each context is, many: whether it is in other texts too; then only repeats with occurrences in two texts count.
        """
        n = len(self.order)
        left, right = np.full(n, -1), np.full(n, -1)
        for before, after, number, place in self.found():
            members = self.order[place]
            if text is not None:
                first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])[: len(number)]
                across = np.zeros(len(before), bool)
                np.logical_or.at(across, number, many[members] | (text[members] != text[members[first]][number]))
                members, number = members[across[number]], number[across[number]]
            np.maximum.at(left, members, before[number])
            np.maximum.at(right, members, after[number])
        return left, right


def _reach_rows(length: int, wide: int, across: bool):
    """Over rows (key, shared, ctx, ctx2, rid, t1, t2, c, left, right) sorted by key, an anchor's contexts together: what maximal repeats cover of each context."""

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            if held.num_rows < 4096:
                continue
            key = held.column(0).to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            if not len(change):
                continue
            cut = int(change[-1]) + 1
            yield from flush(held.slice(0, cut))
            held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from flush(held)

    def flush(all_rows):
        key = all_rows.column(0).to_numpy()
        at = 0
        while at < len(key):  # a few thousand contexts at a time, anchors whole
            end = min(len(key), at + 4096)
            end += int(np.searchsorted(key[end:], key[end - 1], side="right")) if end < len(key) else 0
            rows = all_rows.slice(at, end - at)
            sa = SuffixArray(key[at:end], rows.column(8).to_pylist(), rows.column(9).to_pylist(), length, wide)
            shared = rows.column(1).to_numpy(zero_copy_only=False)
            left, right = sa.reach(rows.column(5).to_numpy(), shared) if across else sa.reach()
            found = (left >= 0) & ~shared  # a shared context is covered as a whole anyway
            cols = [rows.column(i).filter(pa.array(found)) for i in (0, 2, 3, 4, 5, 6, 7)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(left[found].astype(np.int32)), pa.array(right[found].astype(np.int32))], ["key", "ctx", "ctx2", *TEXT, "c", "left", "right"])
            at = end

    return run


REACH = "key long, ctx long, ctx2 long, rid long, t1 long, t2 long, c int, left int, right int"


def _context_rows(length: int, wide: int):
    """Rows (rid, t1, t2, text, todo) to one row per context with its left side, nearest first, and its right side."""

    def run(batches):
        for b in pieces(batches, 1 << 18, 3):
            cols: list[list] = [[] for _ in range(10)]
            for name, t, todo in zip(_names(b), texts(b.column(3)), b.column(4).to_pylist(), strict=True):
                d = symbols(t, wide)
                back = np.ascontiguousarray(_numbers(d, wide)[::-1]).tobytes()
                n = len(d) // wide
                for x in todo:
                    c, s = x["c"], x["s"]
                    row = (x["key"], x["shared"], x["ctx"], x["ctx2"], *name, c, back[(n - c) * wide : (n - max(0, c - s)) * wide], d[c * wide : (c + length) * wide])
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.bool_(), *(pa.int64(),) * 5, pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["key", "shared", "ctx", "ctx2", *TEXT, "c", "left", "right"])

    return run


CONTEXT = "key long, shared boolean, ctx long, ctx2 long, rid long, t1 long, t2 long, c int, left binary, right binary"


def _text() -> F.Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _identity(text: F.Column) -> list[F.Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), _text()).alias("rid"), *_identity(_text()), _text().alias("text"))


def _once(rows: DataFrame) -> DataFrame:
    """A row per place of each distinct text, that of the least rid: copies of a text fall together in the tasks that read them, before any shuffle."""
    return rows.groupBy(*[x for x in rows.columns if x != "rid"]).agg(F.min("rid").alias("rid"))


def _live(rows: DataFrame, name: str, across: bool) -> DataFrame:
    """Rows whose anchor occurs in two places or more, with: n, the contexts of the anchor; whether the context
    is in two places (two texts, if across); whether the row stands for it. rows: a row per place."""
    place, many = F.xxhash64("t1", "t2", F.shiftright("at", 32)), F.col("at").bitwiseAND(F.lit(1).cast("long"))
    if across:
        several = (F.min("t1") != F.max("t1")) | (F.min("t2") != F.max("t2")) | (F.max(many) > 0)
    else:
        several = F.min(place) != F.max(place)
    contexts = staged(rows.groupBy("key", "ctx", "ctx2").agg(F.min(place).alias("first"), several.alias("shared")), f"{name}-contexts")
    keys = contexts.groupBy("key").agg(F.count("*").alias("n"), F.max("shared").alias("some")).where("n > 1 or some").select("key", "n")
    # a table of its own, so that the join below shuffles both sides for itself, and nothing after it needs its order: Spark can split a hot context
    some = staged(contexts.join(keys, "key"), f"{name}-live-contexts")
    live = rows.join(some.hint("merge"), ["key", "ctx", "ctx2"]).withColumn("stands", place == F.col("first")).drop("first")
    c, s = F.shiftright("at", 32).cast("int"), F.shiftright(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")
    live = staged(live.select("*", c.alias("c"), s.alias("s")).drop("at"), f"{name}-live")
    discard(rows, contexts, some)
    return live


def _ranges(text: bytes, wide: int, start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Spans of bytes, in order and apart, that ranges of symbols cover."""
    if wide > 1:
        words = [m.span() for m in _WORD.finditer(text)]
    n = len(words) if wide > 1 else len(text)
    order = np.argsort(start, kind="stable")
    low, high = np.maximum(start[order], 0), np.maximum.accumulate(np.minimum(stop[order], n))
    first = np.flatnonzero(np.r_[True, low[1:] > high[:-1]][: len(low)])
    spans = list(zip(low[first].tolist(), high[np.r_[first[1:] - 1, len(low) - 1]].tolist(), strict=True)) if len(low) else []
    return spans if wide == 1 else [(words[a][0], words[z - 1][1]) for a, z in spans]


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _merge(wide: int):
    """Rows (t1, t2, text, ranges) to (t1, t2, spans, n_removed, kept_sha256)."""

    def run(batches):
        for b in pieces(batches, 1 << 20, 2):
            out: list[list] = [[], [], []]
            ranges = b.column(3)
            ends = np.cumsum(pc.list_value_length(ranges).to_numpy())
            start, stop = (ranges.flatten().field(i).to_numpy() for i in range(2))
            for d, lo, hi in zip(texts(b.column(2)), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                spans = _ranges(d, wide, start[lo:hi], stop[lo:hi])
                for col, v in zip(out, ([{"start": a, "stop": z} for a, z in spans], sum(z - a for a, z in spans), hashlib.sha256(cut_bytes(d, spans)).hexdigest()), strict=True):
                    col.append(v)
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], span), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["t1", "t2", "spans", "n_removed", "kept_sha256"])

    return run


def cut_bytes(text: bytes, spans) -> bytes:
    out, at = [], 0
    for a, z in spans:
        out.append(text[at:a])
        at = z
    return b"".join([*out, text[at:]])


SPANS = "t1 long, t2 long, spans array<struct<start:int,stop:int>>, n_removed long, kept_sha256 string"


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, words: bool = False, across: bool = False) -> DataFrame:
    """(t1, t2, spans, n_removed, kept_sha256) of each distinct text, named by 128 bits, that loses bytes.

    spans are the maximal runs of bytes covered by strings of `length` bytes that start in two places or
    more, in other texts or the same; a text with a copy is not told from a single one (see removals). With `words`, length
    and anchor count words, equal whatever blanks part them, and spans go from word to word. With `across`, only
    strings that two different texts hold count. Null and empty texts cover nothing; ids may repeat or be null.
    `hot` bounds the contexts of one anchor that a task holds.
    """
    wide = 8 if words else 1
    found = _identified(docs)
    rows = staged(_once(anchor_rows(found, length, anchor, wide)), "anchors")
    covers, used, level, candidates = [], [], 0, None
    while True:
        live = _live(rows, f"repeats{level}", across)
        if candidates is None:  # later levels cut the same texts finer
            candidates = staged(found.join(live.select(*TEXT).distinct(), [*TEXT], "left_semi").dropDuplicates([*TEXT]), "candidates")
        whole = live.where("shared").select(*TEXT, (F.col("c") - F.col("s")).alias("start"), (F.col("c") + length).alias("stop"))
        todo = live.where(f"stands and n between 2 and {hot}").groupBy(*TEXT).agg(F.collect_list(F.struct("key", "shared", "ctx", "ctx2", "c", "s")).alias("todo"))
        contexts = candidates.join(todo, [*TEXT]).select(*TEXT, "text", "todo").mapInArrow(_context_rows(length, wide), CONTEXT)
        reach = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_reach_rows(length, wide, across), REACH)
        if across:  # a context may stand in several places of one text
            reach = reach.drop(*TEXT, "c").join(live.select("key", "ctx", "ctx2", *TEXT, "c"), ["key", "ctx", "ctx2"])
        reach = staged(reach.select(*TEXT, (F.col("c") - F.col("left")).alias("start"), (F.col("c") + F.col("right")).alias("stop")), f"reach{level}")
        covers += [whole, reach]
        used += [live, reach]
        split = live.where(f"n > {hot}").where("stands or not shared").withColumn("many", F.col("shared") & F.lit(across))
        if level == len(SLICES) or not split.limit(1).count():
            break
        rows = staged(_once(slice_rows(split, candidates, length, SLICES[level], wide)), f"slices{level}")
        level += 1
    all_covers = covers[0]
    for more in covers[1:]:
        all_covers = all_covers.unionByName(more)
    ranges = all_covers.groupBy(*TEXT).agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    out = staged(candidates.join(ranges, [*TEXT]).select("t1", "t2", "text", "ranges").mapInArrow(_merge(wide), SPANS), "spans")
    discard(candidates, *used)
    return out


def removals(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (null: nothing is removed). For bytes, not words."""
    text = _text()
    size = F.octet_length(text).cast("long")
    base = staged(docs.select(F.col("doc_id").cast("long"), *_identity(text), size.alias("n_bytes"), size.alias("size"), F.sha2(text.cast("binary"), 256).alias("sha")), "documents")
    spans = repeated_spans(docs, length, **options)
    cut = staged(with_copies(base, spans, length), "removed")
    discard(spans)
    none = F.lit(0).cast("long")
    return base.join(cut, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.when(F.col("spans").isNull(), none).otherwise(F.size("spans").cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "spans",
    )


def with_copies(base: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """spans with the texts that have copies among base(t1, t2, size, n_bytes): as repeats of their whole length they lose everything."""
    copied = base.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("n_bytes").alias("n_bytes")).where(f"n > 1 and size >= {length}")
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))
    copied = copied.select("t1", "t2", everything.alias("spans"), F.col("n_bytes").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    return copied.unionByName(spans.join(copied.select("t1", "t2"), ["t1", "t2"], "left_anti"))


def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if s is None else cut_bytes((t or "").encode(), [(x["start"], x["stop"]) for x in s]).decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)], dtype=object)


@columns_apart
def cut_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """docs with repeated passages cut out of the text; columns and rows stay, a character cut in two goes, a null text stays null.

    Copies of a text are repeats of each other, but not with `across`, where a text counts once however many rows hold it.
    """
    text = _text()
    spans = repeated_spans(docs, length, **options)
    if not options.get("across"):
        n_bytes = F.octet_length(text).cast("long")
        size = F.regexp_count(text, F.lit(WORD)).cast("long") if options.get("words") else n_bytes
        spans = with_copies(docs.select(*_identity(text), size.alias("size"), n_bytes.alias("n_bytes")), spans, length)
    cut = spans.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("spans").alias("_spans"))
    t1, t2 = _identity(text)
    joined = docs.withColumn("_t1", t1).withColumn("_t2", t2).join(cut, ["_t1", "_t2"], "left")
    new = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.pandas_udf(_cut, "string")("text", "_spans"))
    return joined.withColumn("text", new).select(docs.columns)
