import itertools
import random
import re

import numpy as np
import xxhash

from quire.llm import simhash
from quire.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, label int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", 0, "clash", 1) for d, t in rows], SCHEMA)


def test_matches_brute_force_with_odd_rows(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)] + ["É", "straße"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    for i in range(200, 400):
        w = rows[rng.randrange(200)][1].split(" ")
        if len(w) > 3:
            w[rng.randrange(len(w))] = "x"
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "one two"), (None, None), (5, rows[5][1]), (903, "A b\x0bC  d"), (904, "a B c D"), (905, "long " * 30000)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_index_finds_all_pairs_in_dense_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 22, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 22, 300).astype(np.uint64)) for b in base]))
    index = simhash.GrayIndex(fps, np.zeros(len(fps), np.int64))
    got = {(int(i), int(j)) for a, b in index.links(2, wide=500) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(fps)) for j in range(i) if (int(index.fps[i]) ^ int(index.fps[j])).bit_count() <= 2}
    assert got == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_keep_one_keeps_all_clean_rows(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (7, "quite another text with its own words"), (None, "x y z"), (None, "x y z")]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(frame(spark, rows)).collect())
    assert left == [(0, "x y z"), (1, "a b c d e"), (7, rows[3][1])]
