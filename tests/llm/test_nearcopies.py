import itertools
import random

import numpy as np

import corpus_pipeline
from quire.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min((d is None, d or 0) for d in g) for g in groups.values())


def edited(rng, text, n):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, None, "s", 0) for d, t in rows], SCHEMA)
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect())


def test_near_copies_go(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, text(rng.randint(1, 300))) for i in range(60)] + [(100 + i, text(300)) for i in range(40)]
    for i in range(40):
        rows.append((200 + i, edited(rng, rows[60 + i][1], 1 + i % 10)))  # 0.7 to 0.97
    rows += [(300, None), (301, ""), (302, " \t"), (None, rows[70][1].upper()), (None, text(9)), (303, "one two"), (304, "One  two"), (5, rows[5][1])]
    want = kept_by_brute_force(rows)
    assert len(want) < len(rows) - 30
    assert kept(spark, rows) == want


def test_one_large_group_and_chains(spark):
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    rows = [(i, edited(rng, base, rng.choice([1, 2, 3, 9]))) for i in range(80)]
    chain = [base + " " + " ".join(f"c{i}" for i in range(60))]
    for _ in range(12):
        chain.append(edited(rng, chain[-1], 4))
    rows += [(500 - i, t) for i, t in enumerate(chain)]
    assert kept(spark, rows) == kept_by_brute_force(rows)


def test_no_rows(spark):
    assert kept(spark, []) == []


def test_sets_decide():
    a = nearcopies.shingles(b"a b c d e f g h")
    assert len(a) == 4 and nearcopies.similar(a, a) and not nearcopies.similar(a, a[:3])


def test_sketches_hold_no_similar_pair_back():
    """Pairs at the limit, of short and long texts: their texts are compared."""
    rng = np.random.default_rng(3)
    for n, rounds in ((40, 100), (500, 60), (640, 200), (20000, 60)):
        for k in range(rounds):
            common = rng.integers(0, 2**63, n * 4 // 5, dtype=np.uint64)
            sets = [np.unique(np.r_[common, rng.integers(0, 2**63, n // 10, dtype=np.uint64)]) for _ in range(2)]
            assert nearcopies.similar(*sets)
            rows = [(bytes([9 - i]), len(x), bytes([i]), nearcopies.sketch(x).tobytes()) for i, x in enumerate(sets)]
            assert nearcopies._compared(rows[:1], rows[1:]) == ([b"\x09"], [b"\x08"])
    far = [np.unique(np.r_[common[: n // 2], rng.integers(0, 2**63, n // 2, dtype=np.uint64)]) for _ in range(2)]
    rows = [(bytes([9 - i]), len(x), bytes([i]), nearcopies.sketch(x).tobytes()) for i, x in enumerate(far)]
    assert nearcopies._compared(rows[:1], rows[1:]) == ([], [])


def test_slices_of_a_large_bucket_change_nothing(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, edited(rng, " ".join(base), rng.choice([2, 5, 8, 12]))) for i in range(70)]
    want = kept_by_brute_force(rows)
    monkeypatch.setattr(nearcopies, "SLICE", 7)
    monkeypatch.setattr(nearcopies, "SMALL", 4)
    monkeypatch.setattr(nearcopies, "PIVOTS", 1)
    assert kept(spark, rows) == want and 1 < len(want) < 70
