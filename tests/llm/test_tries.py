import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from quire.llm import tries
from quire.llm.queries import ORACLES

SCHEMA = "conv_id long, turn int, role string, text string, depth string, d int, Conv string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        below = [total[k] for k in children.get(p, [])]
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        total[p] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
    out = []
    for p, cs in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(p)).encode()).hexdigest()
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), *total[p], ends))
    return sorted(out, key=repr)


def trie(spark, rows, **options):
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], SCHEMA)
    return sorted(map(tuple, tries.prefix_trie(df, **options).collect()), key=repr)


def some(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(-120, -90), 5000]:
        kind = rng.random()
        words = ["hi", "yes", "no", ""] if kind < 0.8 else ["hi", f"é😀{c}"]
        turns = 0 if kind > 0.97 else rng.choice([1, 2, 3, 5, 6, 9, 14])
        rows += [(c, t if t else None, rng.choice(["user", None]), rng.choice([*words, None])) for t in range(turns)]
    return rows


@pytest.mark.parametrize(("heavy", "few", "piece", "chunk"), [(1 << 16, 1000, 1 << 16, 4096), (4, 1000, 3, 2), (30, 0, 5, 7)])
def test_matches_brute_force(spark, monkeypatch, heavy, few, piece, chunk):
    """With all nodes light, nearly all heavy, and both; in ranges and pieces of all sizes."""
    monkeypatch.setattr(tries, "RANGE", piece)
    monkeypatch.setattr(tries, "CHUNK", chunk)
    rows = some(heavy)
    assert trie(spark, rows, heavy=heavy, few=few) == plain(rows)


def test_equals_sql(spark):
    rows = [r for r in some(7, 250) if r[1] is not None]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    assert sorted((tuple(r) for r in duckdb.sql(ORACLES["op11_trie"]).fetchall()), key=repr) == plain(rows) == trie(spark, rows, heavy=40)


def test_one_conversation_of_very_many_turns_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(tries, "RANGE", 50)
    rows = [(1, t, "user", f"t{t % 7}") for t in range(400)] + [(c, t, "user", f"same{t}") for c in range(100, 300) for t in range(3)]
    assert trie(spark, rows, heavy=60) == plain(rows)


def test_edges(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(7, None, None, None)], [(100, 1, "u", "x"), (100, 1, "u", "x"), (None, 1, "u", "x")], [(c, 0, "", "") for c in range(100, 120)]):
        assert trie(spark, rows) == plain(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert trie(spark, [(c, 0, "u", "x")]) == plain([(c, 0, "u", "x")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_equal_turns_are_ordered_alike_everywhere(spark):
    """Repeated turn numbers: the same turns in any order of rows give the same trie."""
    rows = [(c, 1, "u", x) for c in (100, 200) for x in "abcde"]
    once = trie(spark, rows)
    random.Random(1).shuffle(rows)
    assert trie(spark, rows) == once and len([r for r in once if r[1] == 5]) == 1


def test_louds():
    """          0     1
            2  3       4
               5 6           in level order"""
    parent = np.array([-1, -1, 0, 0, 1, 3, 3])
    t = tries.Louds.of(parent)
    assert t.bits.tolist() == [1, 1, 0, 1, 1, 0, 1, 0, 0, 1, 1, 0, 0, 0, 0]
    assert t.parent.tolist() == parent.tolist() and t.degree.tolist() == [2, 1, 0, 2, 0, 0, 0] and t.tops == 2
    assert t.levels() == [(0, 2), (2, 5), (5, 7)]
    assert t.rolled_up(np.ones(7, int)).tolist() == [5, 2, 1, 3, 1, 1, 1]
    assert t.handed_down(np.array([7, 8])).tolist() == [7, 8, 7, 7, 8, 7, 7]
    assert tries.Louds(t.bits).rolled_up(np.arange(7)).tolist() == [16, 5, 2, 14, 4, 5, 6]
