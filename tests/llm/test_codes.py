import hashlib
import math
import random

import numpy as np
import pytest

from quire.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, error string, code int"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, label, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, _, v in kept) // parts)) * parts
    w = width // parts
    kept = [(i, label, v + [0] * (width - len(v))) for i, label, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[v[p * w : (p + 1) * w] for _, _, v in first] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        held = [[[] for _ in book] for book in books]
        for _, _, v in kept:
            for p in range(parts):
                x = v[p * w : (p + 1) * w]
                held[p][near(x, books[p])[0]].append(x)
        books = [[[sum(c) // len(xs) for c in zip(*xs)] if xs else e for e, xs in zip(book, hs)] for book, hs in zip(books, held)]
    out = []
    for i, label, v in kept:
        got = [near(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for k, _ in got), sum(d for _, d in got)))
    sums = {}
    for _, label, _, e in out:
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], sha) for i, label, c, e in out), key=repr)


def compressed(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, codes.compress(df, **options).collect()), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], i % 3 if i % 5 else None) for i in range(200)]
    rows += [(300 + i, rows[7][1], 1) for i in range(90)]  # one vector very often
    rows += [(12, rows[12][1], 0), (12, rows[13][1], 0), (None, rows[3][1], 2), (-7, rows[4][1], None)]
    rows += [(400, None, 1), (401, [None] * 64, 1), (402, [float("nan")] * 64, 1), (403, [float("inf")] + [0.0] * 63, 1), (404, [-1e-9] * 64, 1)]
    assert compressed(spark, rows) == plain(rows)


def test_ties_go_to_the_lower_index_and_unused_entries_stay(spark):
    rows = [(i, [float(i % 2)] * 16, 0) for i in range(80)]
    got = compressed(spark, rows)
    assert got == plain(rows)
    assert {r[1] for r in got} == {"00" * 16, "01" * 16}


@pytest.mark.parametrize("rows", [[(5, [1.0, -2.0, 3.0], 1)], [(1, [], None), (2, [0.5] * 20, None), (3, [0.25] * 17, 1)], [(None, [1.0] * 16, 1)]])
def test_few_and_ragged_rows(spark, rows):
    assert compressed(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert compressed(spark, []) == [] and compressed(spark, [(1, None, 1)]) == []


def test_too_large_is_refused(spark):
    with pytest.raises(Exception, match="too large"):
        compressed(spark, [(1, [1e12] * 64, 1)])


def test_many_labels_join(spark, monkeypatch):
    monkeypatch.setattr(codes, "LABELS", 2)
    rows = [(i, [float(i), -float(i)] * 8, i % 7 or None) for i in range(70)]
    assert compressed(spark, rows) == plain(rows)


def test_exact_at_the_largest_values():
    rng = np.random.default_rng(1)
    top = int((2**61 / 64) ** 0.5) - 1
    rows, books = rng.integers(-top, top, (50, 64)), rng.integers(-top, top, (16, 8, 4))
    index, far = codes.nearest(rows, books)
    for r in range(50):
        for p in range(16):
            d = [sum((int(a) - int(b)) ** 2 for a, b in zip(rows[r, 4 * p : 4 * p + 4], e)) for e in books[p]]
            assert far[r, p] == min(d) and index[r, p] == d.index(min(d))
