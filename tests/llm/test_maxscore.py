import math
import random

import numpy as np
import pytest

from quire.llm import maxscore

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def plain(rows, k=20):
    live = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(live):
        if q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(live) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shape", [{}, {"shard": 16, "block": 5, "group": 2}])
def test_matches_brute_force(spark, shape):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(150)]
    rows += [(200 + i, rows[i % 4][1]) for i in range(60)]  # ties
    rows += [(40, rows[40][1]), (None, rows[0][1]), (300, None), (320, [None] * 12), (340, [float("nan")] * 12), (360, [float("inf")] * 12), (380, [1.0, 2.0]), (400, []), (-20, [0.0] * 12), (420, [1e12] * 12)]
    got = maxscore.top_k(spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA), **shape).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [3.0, -1.0]), (7, [0.5, 0.5])]
    got = maxscore.top_k(spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == plain(rows)
    assert maxscore.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prunes_without_losing_any():
    rng = np.random.default_rng(0)
    parts = rng.poisson(0.2, (3000, 40)) * rng.integers(1, 50, 40)
    q = parts[:20] * 1
    s = maxscore.Searcher(maxscore.Block(np.arange(20), q, np.full(20, -1), np.zeros(20, int)), 5)
    for at in range(0, 3000, 500):
        s.pass_shard(at, np.arange(at, at + 500), parts[at : at + 500])
    for i in range(20):
        scores = parts @ q[i]
        order = np.lexsort((np.arange(3000), -scores))[:5]
        assert s.best[i][0].tolist() == scores[order].tolist() and s.best[i][1].tolist() == order.tolist()
    assert s.probed < 20 * 3000 * 3


@pytest.mark.parametrize("most", [2**22, 2**24, 2**51, 2**53])
@pytest.mark.parametrize("part", [0.4, 0.77, 0.999, 1.001])
def test_exact_on_both_sides_of_each_switch(most, part):
    """Near-parallel vectors of full size, where scores are as large as the bound and differ by little."""
    rng = np.random.default_rng(int(1000 * part))
    wide = 64
    top = int((most * part / wide) ** 0.5)
    base = rng.choice([-top, top], wide)
    parts = np.array([base - np.sign(base) * rng.integers(0, 3, wide) for _ in range(400)], np.int64)
    parts[::7] *= -1
    s = maxscore.Searcher(maxscore.Block(np.arange(20), parts[:20], np.zeros(20, int), np.arange(20)), 5)
    s.pass_shard(0, np.arange(200), parts[:200])
    s.pass_shard(1, np.arange(200, 400), parts[200:])
    for i in range(20):
        scores = np.array([sum(int(x) * int(y) for x, y in zip(parts[i], p)) for p in parts])
        order = [x for x in np.lexsort((np.arange(400), -scores)).tolist() if x != i][:5]
        assert s.best[i][1].tolist() == order and s.best[i][0].tolist() == scores[order].tolist()
