import hashlib
import json
import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import bpe, token_counts
from quire.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, n_tokens string, ids int"
PATH = tokenizer_path()
EOD = token_counts.special_id(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "clash", 1) for d, t in rows], SCHEMA)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "aaabbcehilnorst'''  ..!!İΣσßéèöñü一日本語́​﻿ \t\n0123½²٣👍🏽éÅΩ\x1c\x85"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + ["<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "hello" * 300, "ab" * 3000, "I'LL they're x's", " \n "]


def test_ids_and_text_as_the_library(spark, library):
    rows = list(enumerate(odd_texts(800))) + [(5000, None), (5001, ""), (None, "null id"), (3, "again"), (3, "again"), (5002, "many words " * 40000)]
    got = sorted(tuple(map(str, r)) for r in bpe.digests(frame(spark, rows), PATH).collect())
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(tuple(map(str, r)) for r in want)


def test_encode_then_decode(spark, library):
    rows = list(enumerate(odd_texts(50, 2)))
    both = {r["doc_id"]: r for r in bpe.encode(frame(spark, rows), PATH, with_text=True).collect()}
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(frame(spark, rows), PATH), PATH).collect()}
    for d, t in rows:
        assert back[d] == both[d]["decoded"] == library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.digests(frame(spark, []), PATH).count() == 0


def test_pair_checks_agree_with_merging():
    e = bpe.encoder(PATH)
    rng = np.random.default_rng(3)
    tokens = np.flatnonzero(e.reachable & np.array([not s.startswith("<|") and len(s) < 9 for s in e.strings]))
    a = tokens[rng.integers(0, len(tokens), 30000)]
    b = tokens[rng.integers(0, len(tokens), 30000)]
    keep = np.array([not e.strings[i].endswith("</w>") for i in a])
    a, b = a[keep], b[keep]
    split = lambda s: [*s.removesuffix("</w>")[:-1], s.removesuffix("</w>")[-1] + "</w>" * s.endswith("</w>")]
    want = [e.merge([*e.strings[i], *split(e.strings[j])]) == [i, j] for i, j in zip(a.tolist(), b.tolist())]
    assert e.compatible(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_small_cache_changes_nothing(library):
    e = bpe.WordBpe(PATH, cache_words=50)
    texts = ["alpha beta gamma", " ".join(f"word{i}" for i in range(300)), "alpha omega"] * 3
    assert [np.frombuffer(i, "<u4").tolist() for i in e.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# -- token files -------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_counts_in_flat_files(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for name in ("a", "b", "c"):
        docs = [[rng.randrange(1, 9) for _ in range(rng.choice([0, 0, 1, 3, 200]))] for _ in range(30)]
        flat = [i for d in docs for i in [*d, 0]]
        if name == "b":
            flat += [5, 5]
            docs.append([5, 5])
        np.array(flat, "<u2").tofile(tmp_path / f"{name}.bin")
        want += [(name, i, len(d), name != "b" or i < 30) for i, d in enumerate(docs)]
    (tmp_path / "empty.bin").write_bytes(b"")
    got = token_counts.count_tokens(token_counts.read_blocks(spark, str(tmp_path), block=block), 0).collect()
    assert sorted((r["file"].rpartition("/")[2][0], r["ordinal"], r["n_tokens"], r["ended"]) for r in got) == sorted(want)


def test_large_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "READ", 1000)
    monkeypatch.setattr(token_counts, "RUN", 5)
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40, 50001).astype("<u4")
    ids.tofile(tmp_path / "x.bin")
    blocks = token_counts.read_blocks(spark, str(tmp_path), width=4, block=64)
    assert blocks.count() == -(-50001 // 64) and blocks.rdd.getNumPartitions() == 16
    got = {r["ordinal"]: r["n_tokens"] for r in token_counts.count_tokens(blocks, 0, width=4).collect()}
    ends = np.flatnonzero(ids == 0)
    assert [got[i] for i in range(len(ends))] == (np.diff(np.r_[-1, ends]) - 1).tolist()


def test_what_does_not_fit_is_refused(spark, tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    with pytest.raises(ValueError, match="need more than 1 bytes"):
        token_counts.token_table(frame(spark, [(1, "x")]), PATH, EOD, width=1)
    for change in (lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\S+"), lambda s: s.update(normalizer=None), lambda s: s["model"].update(dropout=0.1)):
        other = json.loads(json.dumps(spec))
        change(other)
        with pytest.raises(ValueError, match="another way"):
            bpe.WordBpe.check(other, "x")
    (tmp_path / "t.json").write_text(json.dumps({"added_tokens": []}))
    with pytest.raises(ValueError, match="has no"):
        token_counts.special_id(str(tmp_path / "t.json"))


def test_broken_file_is_refused(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole ids"):
        token_counts.read_blocks(spark, str(tmp_path)).collect()


def test_counts_of_documents(spark, library):
    rows = list(enumerate(odd_texts(200, 5))) + [(5000, None), (5001, ""), (None, "null id"), (3, "again"), (3, "again"), (5002, "many words " * 40000)]
    library.encode_special_tokens = True
    want = sorted(str((d, len(library.encode(t or "", add_special_tokens=False).ids))) for d, t in rows)
    library.encode_special_tokens = False
    assert sorted(str(tuple(r)) for r in token_counts.count_documents(frame(spark, rows), PATH, EOD, block=500).collect()) == want
    assert token_counts.count_documents(frame(spark, []), PATH, EOD).count() == 0


@pytest.mark.parametrize("word", ["abcdefghij" * 100_000, "éü" * 300_000, "qzxj" * 250_000])
def test_one_very_long_word(library, word):
    """About a megabyte without a break, in time that stays near the library's."""
    began = time.perf_counter()
    want = library.encode(word, add_special_tokens=False).ids
    theirs, began = time.perf_counter() - began, time.perf_counter()
    got = np.frombuffer(bpe.WordBpe(PATH).encode_batch([word])[0], "<u4").tolist()
    assert got == want and time.perf_counter() - began < 20 + 3 * theirs
