import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import common, repeats
from quire.sources import staging

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tid long, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", 0, 1, "clash") for d, t in rows], SCHEMA)


def plain(texts, length):
    """Per text: (n_removed, n_spans, kept sha256), straight from the definition."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i + 1 : i + 1 + length] = True
        spans = int((cover[1:] & ~cover[:-1]).sum())
        kept = bytes(b for b, c in zip(d, cover[1:]) if not c)
        out.append((len(d), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, many=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = [text(n) for n in (70, 90, 75, 120)]
    out = []
    for i in range(many):
        t = text(rng.randint(0, 120))
        for p in rng.sample(passage, rng.randint(0, 2)):
            a = rng.randrange(max(1, len(p) - 400))
            t = t + p[a : a + rng.randint(380, 460)] + text(rng.randint(0, 50))
        out.append(t)
    for t in out[:12]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    out += [out[0], out[1], None, "", None, "short", "ab" * 900, "xyz" * 400, "a" * 401, "a" * 400, "b" * 399, "\x00" * 450 + "q", passage[0] + text(40) + passage[0]]
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_matches_the_definition(spark, hot):
    texts = corpus(5)
    rows = [(None if i % 17 == 3 else i, t) for i, t in enumerate(texts)] + [(4, texts[4])]
    want = sorted(zip([str(d) for d, _ in rows], plain([t for _, t in rows], 400)))
    got = repeats.removals(frame(spark, rows), hot=hot).collect()
    assert sorted((str(r["doc_id"]), (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == want


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1500)
    rng = np.random.default_rng(0)
    base = bytes(rng.integers(97, 123, 9000, dtype=np.uint8))
    doc = base + base[2000:3000] + base[5000:5399] + b"!" + base[100:600]
    doc = np.frombuffer(doc, np.uint8)
    whole = repeats.anchors([doc], 400, 128)[0][0]
    monkeypatch.setattr(repeats, "BLOCK", 1 << 20)
    assert whole.tolist() == repeats.anchors([doc], 400, 128)[0][0].tolist()
    assert np.diff(np.r_[0, whole, len(doc) - 128]).max() <= 273


def test_empty_table(spark):
    assert repeats.removals(frame(spark, [])).count() == 0
    assert repeats.cut_repeats(frame(spark, [])).count() == 0


def test_groups_are_maximal_repeats_with_all_occurrences():
    rng = random.Random(2)
    text = "".join(rng.choice("abcd") for _ in range(60))
    core = "COREcore"
    sides = [("", ""), ("x", "y"), ("x", "z"), ("wx", "y"), ("vx", "yy")]
    docs = [f"{text[i * 7:]}{a}{core}{b}{text[i * 3:]}"[:90] for i, (a, b) in enumerate(sides)]
    at = [d.index(core) for d in docs]
    left, right = [d[:c][::-1].encode() for d, c in zip(docs, at)], [d[c:].encode() for d, c in zip(docs, at)]
    sa = repeats.SuffixArray(np.zeros(len(docs), np.int64), left, right, 100)
    got = {(docs[m[0]][at[m[0]] - a : at[m[0]] + b], tuple(m.tolist())) for a, b, m in sa.groups(9)}
    want = set()
    subs = {d[i:j] for d, c in zip(docs, at) for i in range(c + 1) for j in range(c + len(core), len(d) + 1) if j - i >= 9}
    for s in subs:
        who = [k for k, d in enumerate(docs) if d[max(0, at[k] - s.index(core)) :].startswith(s) and at[k] >= s.index(core)]
        if len(who) < 2:
            continue
        i = s.index(core)
        before = {docs[k][at[k] - i - 1 : at[k] - i] if at[k] > i else (k,) for k in who}
        after = {docs[k][at[k] - i + len(s) :][:1] or (k,) for k in who}
        if len(before) > 1 and len(after) > 1:
            want.add((s, tuple(who)))
    assert got == want


def test_cut_keeps_columns_and_rows(spark):
    texts = corpus(9, 20)
    docs = frame(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["text"] for r in repeats.cut_repeats(docs).collect()}
    want = plain(texts, 400)
    assert repeats.cut_repeats(docs).columns == docs.columns
    for i, t in enumerate(texts):
        assert (got[i] is None) == (t is None)
        if t is not None and want[i][1] == 0:
            assert got[i] == t
        elif t is not None and t.isascii():
            assert hashlib.sha256(got[i].encode()).hexdigest() == want[i][3]


def plain_words(texts, length, across=True):
    """What is left of each text without words that strings of `length` words cover which two different texts hold."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    where = defaultdict(set)
    for t, w in zip(texts, words):
        for i in range(len(w) - length + 1):
            where[tuple(w[i : i + length])].add(t)
    out = []
    for t, w in zip(texts, words):
        cover = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - length + 1):
            if len(where[tuple(w[i : i + length])]) > 1:
                cover[i : i + length] = True
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        left, at, i = "", 0, 0
        while i < len(w):
            if cover[i]:
                j = i
                while cover[j + 1]:
                    j += 1
                left, at, i = left + t[at : places[i][0]], places[j][1], j
            i += 1
        out.append(None if t is None else left + t[at:])
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_passages_of_words_across_texts(spark, hot):
    texts = corpus(11, 50)
    rng = random.Random(3)
    own = " ".join(f"own{rng.randrange(50)}" for _ in range(70))  # twice in one text: no other text holds it
    passage = " ".join(f"é{rng.randrange(90)}" for _ in range(51))
    texts += [own + " x " + own, "a\t" + passage.replace(" ", "\n", 30) + " b", "c " + passage, passage[: passage.rindex(" ")] + " d", own.replace("own", "two") + " " + passage + " " + own.replace("own", "two") + " " + passage]
    texts += ["w " * 300, "v w " * 200, "w " * 60 + own[:9]]
    docs = frame(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["text"] for r in repeats.cut_repeats(docs, 51, anchor=16, words=True, across=True, hot=hot).collect()}
    want = plain_words(texts, 51)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(a != b for a, b in zip(texts, want)) > 20 and got[len(texts) - 8] == texts[-8]


def test_across_holds_for_bytes_too(spark):
    rng = random.Random(4)
    a = "".join(rng.choice("abcdef") for _ in range(450))
    texts = [a + "1" + a, a[:399], "zz" + a[10:430], "b" * 1000, "c" * 500 + a[:100]]
    got = {r["doc_id"]: r["text"] for r in repeats.cut_repeats(frame(spark, list(enumerate(texts))), across=True, hot=1).collect()}
    assert got == {0: a[:10] + a[430:] + "1" + a[:10] + a[430:], 1: texts[1], 2: "zz", 3: texts[3], 4: texts[4]}


def test_nothing_staged_is_left_but_what_is_read(spark):
    with common.owned("repeats"):
        repeats.removals(frame(spark, list(enumerate(corpus(2, 10)))), hot=3).count()
    assert list(staging._written.values()).count("repeats") == 2
    common.release(spark, "repeats")
    assert "repeats" not in staging._written.values()


@pytest.mark.parametrize("turned", [False, True])
def test_nul_bytes_inside_and_at_ends(spark, turned):
    """A text and the same text plus NULs differ, in whatever order they come."""
    rng = random.Random(11)
    base = ["".join(rng.choice("a\0") for _ in range(rng.choice([5, 20, 450, 600]))) for _ in range(12)]
    texts = [t + "\0" * rng.choice([0, 0, 1, 2, 5, 400]) for t in base for _ in range(4)] + ["\0" * n for n in (399, 400, 401, 800)] + [("\0" * 3 + t)[:-2] for t in base]
    texts = texts[::-1] if turned else texts
    want = plain(texts, 400)
    got = sorted(repeats.removals(frame(spark, list(enumerate(texts)))).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == want
