"""BPE encoding and decoding by speculation: longest match proposes, pair checks verify, exact merging mends.

A word's pieces are its exact encoding if and only if every piece is reachable by merges and every
adjacent pair is left alone when the two are merged side by side. So the distinct words of a batch
are cut greedily into longest tokens, all distinct adjacent pairs are tested at once with numpy, and
only words with a failing pair or an unreachable piece are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pieces

FAR = np.iinfo(np.int64).max

#: Texts of these characters alone are unchanged by NFC and lower-cased alike everywhere; the splitter's
#: classes are plain sets there, so the standard library's faster expressions do.
COMMON = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xFF]*")
COMMON_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF]+|[0-9\xB2\xB3\xB9\xBC-\xBE]|[^\sa-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF0-9\xB2\xB3\xB9\xBC-\xBE]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class WordBpe:
    """Encoder for a `tokenizers` JSON file of BPE with word ends; the file's normaliser is its own. A file whose splitter or merging is another is refused."""

    #: The file's pattern of words.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, cache_words: int = 200_000, specials: bool = True):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.check(spec, path)
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.on_special = regex.compile("|".join(f"({regex.escape(t)})" for t in self.special)) if self.special and specials else None
        self.words = regex.compile(self.PATTERN)
        self.letters = _byte_letters()
        self.vocab: dict[str, int] = model["vocab"]
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank, self.left, self.right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        for r, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pairs[x, y] = (r, z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([x * size + y for x, y in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.pairs.values()])[order]
        self.made = np.zeros(len(merges), dtype=np.int64)
        self.made[self.pair_ranks] = [self.pairs[k // size, k % size][1] for k in self.pair_keys.tolist()]
        self.size, self.longest = size, {}
        for token in self.vocab:
            body = token.removesuffix(self.end)
            if body:
                self.longest[body[:2]] = max(self.longest.get(body[:2], 1), len(body))
        self.longest_end = max(len(t) - len(self.end) for t in self.vocab if t.endswith(self.end))
        self.cache: dict[str, bytes] = {}
        self.cache_words, self.mended = cache_words, 0
        self.inner = np.array([self.vocab.get(c, -1) for c in self.letters])
        self.last = np.array([self.vocab.get(c + self.end, -1) for c in self.letters])
        self.complete = bool((self.inner >= 0).all() and (self.last >= 0).all())
        self.reachable = self.find_reachable()

    @classmethod
    def check(cls, spec: dict, path: str) -> None:
        """Refuses a file that this encoder would not follow."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        split = steps[0] if len(steps) == 2 else {}
        known = split.get("type") == "Split" and split.get("pattern") == {"Regex": cls.PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
        letters = known and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and steps[1].get("use_regex") is False
        if not letters:
            raise ValueError(f"{path}: splits words in another way than this encoder")
        lower = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if lower != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: normalises in another way than this encoder")
        model = spec["model"]
        if model.get("type") != "BPE" or not model.get("end_of_word_suffix") or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: merges in another way than this encoder")

    # -- speculation -------------------------------------------------------------------------
    def symbols(self, word: str) -> list[str]:
        out = [self.letters[b] for b in word.encode()]
        out[-1] += self.end
        return out

    def longest_match(self, word: str) -> list[int]:
        """Greedy cut into the longest tokens; empty if a symbol has no token."""
        letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        vocab, longest, n, at, out = self.vocab, self.longest, len(letters), 0, []
        while True:
            token = vocab.get(letters[at:] + self.end) if n - at <= self.longest_end else None
            if token is not None:
                out.append(token)
                return out
            for stop in range(min(n - 1, at + longest.get(letters[at : at + 2], 1)), at, -1):
                token = vocab.get(letters[at:stop])
                if token is not None:
                    break
            else:
                return []
            out.append(token)
            at = stop

    # -- verification ------------------------------------------------------------------------
    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], FAR)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of reachable tokens: do both survive when merged side by side?

        The right edge of a and the left edge of b grow, piece by piece, in the order of their merges.
        The pair fails if two pieces that meet on the way merge sooner than either of them grows.
        Walked backwards: the piece made last is undone first.
        """
        x, y = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        grows_x, grows_y = np.full(len(x), FAR), np.full(len(y), FAR)
        ok, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            r = self.merge_rank(u, v)
            bad = (r != FAR) & (r < grows_x[live]) & (r <= grows_y[live])  # equal merges: the left one comes first
            ok[live[bad]] = False
            live, u, v = live[~bad], u[~bad], v[~bad]
            ru, rv = self.rank[u], self.rank[v]
            go = (ru >= 0) | (rv >= 0)
            live, u, v, ru, rv = live[go], u[go], v[go], ru[go], rv[go]
            undo_x = ru >= rv
            i, j = live[undo_x], live[~undo_x]
            grows_x[i], x[i] = ru[undo_x], self.right[u[undo_x]]
            grows_y[j], y[j] = rv[~undo_x], self.left[v[~undo_x]]
        return ok

    def find_reachable(self) -> np.ndarray:
        """Does merging a token's own symbols give the token? Base symbols do; nothing stands for an id without a merge."""
        out = np.ones(self.size, bool)
        made = np.flatnonzero(self.rank >= 0)
        ends = np.array([self.strings[i].endswith(self.end) for i in made])
        code = {c: b for b, c in enumerate(self.letters)}
        bodies = [bytes(code[c] for c in self.strings[i].removesuffix(self.end)) for i in made.tolist()]
        for kind in (False, True):
            own = np.flatnonzero(ends == kind)
            got = self.merge_many([bodies[i] for i in own.tolist()], kind)
            out[made[own]] = [g == [i] for g, i in zip(got, made[own].tolist(), strict=True)]
        return out

    # -- exact merging -----------------------------------------------------------------------
    def merge_many(self, words: list[bytes], ended: bool = True, rows: int = 4096) -> list[list[int]]:
        """merge() for many words at once: a row each, padded; every step merges each row's best pair."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order:
            short, order = order[:rows], order[rows:]
            if not self.complete or len(words[short[-1]]) > 48:
                for i in short:
                    symbols = [self.letters[b] for b in words[i]]
                    symbols[-1] += self.end * ended
                    out[i] = self.merge(symbols)
                continue
            n = np.array([len(words[i]) for i in short])
            wide = int(n.max())
            inside = np.arange(wide) < n[:, None]
            ids = np.full((len(short), wide + 1), -1, dtype=np.int64)
            codes = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
            ids[:, :wide][inside] = self.inner[codes]
            if ended:
                ids[np.arange(len(short)), n - 1] = self.last[codes[np.cumsum(n) - 1]]
            which = np.array(short)
            a, b = ids[:, :-1], ids[:, 1:]
            ranks = np.where((a >= 0) & (b >= 0), self.merge_rank(a, b), FAR)
            while True:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(at)), at]
                live = best != FAR
                for i, row in zip(which[~live].tolist(), ids[~live].tolist(), strict=True):
                    out[i] = row[: row.index(-1)]
                if not live.any():
                    break
                which, ids, ranks, at, best = which[live], ids[live], ranks[live], at[live], best[live]
                row, last = np.arange(len(at)), ids.shape[1] - 1
                source = np.arange(last + 1)[None, :] + (np.arange(last + 1)[None, :] > at[:, None])
                ids = np.where(source <= last, np.take_along_axis(ids, np.minimum(source, last), 1), -1)
                ranks = np.where(source[:, :-1] < last, np.take_along_axis(ranks, np.minimum(source[:, :-1], last - 1), 1), FAR)
                ids[row, at] = self.made[best]
                for off in (-1, 0):
                    x = at + off
                    r = row[(x >= 0) & (x < last)]
                    x = x[(x >= 0) & (x < last)]
                    u, v = ids[r, x], ids[r, x + 1]
                    ranks[r, x] = np.where(v >= 0, self.merge_rank(u, v), FAR)
        return out

    def merge(self, symbols: list[str]) -> list[int]:
        """The merges in order of rank, leftmost first; symbols without a token vanish, as in the library."""
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := self.pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.pairs[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if p := self.pairs.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (p[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (p := self.pairs.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (p[0], before[i], ids[before[i]], ids[i]))
        return [x for x in ids if x >= 0]

    # -- words and texts ---------------------------------------------------------------------
    def learn(self, words: list[str]) -> None:
        """Encodes new words into the cache: speculate, verify all pairs at once, mend the rest."""
        tried = [self.longest_match(w) for w in words]
        size = np.array([len(t) for t in tried])
        flat = np.array([i for t in tried for i in t], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), size)
        fails = size == 0
        fails[word[~self.reachable[flat]]] = True
        near = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(flat[near] * self.size + flat[near + 1], return_inverse=True)
        fails[word[near[~self.compatible(pairs // self.size, pairs % self.size)[which]]]] = True
        wrong = np.flatnonzero(fails).tolist()
        for i, ids in zip(wrong, self.merge_many([words[i].encode() for i in wrong]), strict=True):
            tried[i] = ids
        self.mended += len(wrong)
        for w, ids in zip(words, tried, strict=True):
            self.cache[w] = struct.pack(f"<{len(ids)}I", *ids)

    def plain_words(self, text: str) -> list[str]:
        """Normalises and splits text without special tokens."""
        if COMMON.fullmatch(text):
            return COMMON_WORDS.findall(text.lower())
        return self.words.findall(self.normalise(text))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian uint32."""
        cut = []
        for text in texts:
            if self.on_special is None or not (found := list(self.on_special.finditer(text))):
                cut.append(self.plain_words(text))
                continue
            out, at = [], 0
            for m in found:
                out += self.plain_words(text[at : m.start()])
                out.append(self.special[m[0]])
                at = m.end()
            cut.append(out + self.plain_words(text[at:]))
        seen, known = set().union(*cut), self.cache
        new = seen.difference(known)
        if len(known) + len(new) > self.cache_words:
            known.clear()
            new = seen
        known.update({i: struct.pack("<I", i) for i in self.special.values()})
        if new := [w for w in new if isinstance(w, str)]:
            self.learn(new)
        return [b"".join([known[w] for w in words]) for words in cut]

    def decode(self, ids: bytes) -> str:
        """As the library without a decoder: the tokens' strings joined by spaces, ids it lacks left out."""
        strings, size = self.strings, self.size
        return " ".join([strings[i] for i in memoryview(ids).cast("I").tolist() if i < size])


@lru_cache(maxsize=2)
def encoder(path: str, specials: bool = True) -> WordBpe:
    """One per worker process; without specials their strings in a text are ordinary text."""
    return WordBpe(path, specials=specials)


def encode(docs: DataFrame, path: str, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32) and, with_text, decoded text; one row per row of docs.

    A null text counts as empty: no ids. Every text is encoded whole; equal rows give equal rows.
    """
    columns = "doc_id long, n_tokens long, ids binary" + ", decoded string" * with_text

    def run(batches):
        e = encoder(path)
        for b in pieces(batches):
            got = e.encode_batch([t or "" for t in b.column(1).to_pylist()])
            cols = [b.column(0), pa.array([len(i) // 4 for i in got], pa.int64()), pa.array(got, pa.binary())]
            if with_text:
                cols.append(pa.array([e.decode(i) for i in got], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of rows with doc_id and ids; null ids give the empty text."""

    def run(batches):
        e = encoder(path)
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(i or b"") for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode, then decode from the ids, both in one pass."""

    def run(batches):
        e = encoder(path)
        for b in pieces(batches):
            got = e.encode_batch([t or "" for t in b.column(1).to_pylist()])
            hexes = [[hashlib.sha256(x).hexdigest() for x in col] for col in (got, (e.decode(i).encode() for i in got))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) // 4 for i in got], pa.int64()), pa.array(hexes[0], pa.string()), pa.array(hexes[1], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
