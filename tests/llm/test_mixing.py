import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target int, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, s, 0, "clash", 7, "clash") for d, t, s in rows], SCHEMA)


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def corpus(many, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * int(rng.paretovariate(0.8) * 5 % 900)), rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(many)]


def targets_plainly(sizes):
    """Water filling by bisection, apart from the operator's way."""
    weights, total = [(5, 2, 1)[i % 3] for i in range(len(sizes))], sum(sizes)
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights)) < total else (low, mid)
    return [min(3 * s, low * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("shape", [{}, {"bucket_rows": 20, "fan_in": 3}])
def test_sources_meet_targets(spark, shape):
    rows = corpus(700) + [(800, None, "a"), (801, "", "only empty"), (None, "x y z", "b"), (None, "x y z", "b"), (802, "  \x0b\tq", "z")] + [(9, "same words here", "hot")] * 300 + [(803, "long " * 50000, "one")]
    got = mixing.mix(frame(spark, rows), **shape).collect()
    assert sorted(str((r["doc_id"], r["source"], r["size"])) for r in got) == sorted(str((d, s, size(t))) for d, t, s in rows)
    total, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, t, s in rows:
        total[s] += size(t)
        largest[s] = max(largest[s], size(t))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, targets_plainly([total[s] for s in names])))
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 3 and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-6, abs=1e-6)
    for s in names:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.mix(frame(spark, random.Random(0).sample(rows, len(rows))).repartition(7), **shape).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_rows_taken_keep_their_columns(spark):
    rows = corpus(60, 3) + [(9, "same words here", "b")] * 20 + [(9, "other words here", "b"), (None, "n n", None)]
    docs = frame(spark, rows)
    got, plan = mixing.apply_mix(docs), mixing.mix(docs).collect()
    assert got.columns == docs.columns
    want = defaultdict(int)
    for r in plan:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    have = Counter((r["doc_id"], r["source"], size(r["text"])) for r in got.collect())
    assert have == {k: v for k, v in want.items() if v}


def test_empty_table(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.apply_mix(frame(spark, [])).count() == 0


def test_pivot_keeps_the_sum_and_the_chances():
    rng = np.random.default_rng(0)
    sizes, probs = sorted(rng.integers(1, 50, 40).astype(float).tolist(), reverse=True), rng.random(40).tolist()
    sizes[0], probs[3], probs[5] = 60.0, 0.0, 1.0
    mean = np.zeros(40)
    for i in range(4000):
        bits, held, p = mixing.pivot(sizes, probs, np.random.default_rng(i))
        total = sum(s * b for s, b in zip(sizes, bits)) + (sizes[held] * p if held >= 0 else 0)
        assert total == pytest.approx(np.dot(sizes, probs))
        assert held < 0 or sizes[held] < sizes[3]
        mean += bits
        if held >= 0:
            mean[held] += p
    assert np.abs(mean / 4000 - probs).max() < 0.05


def test_chances_hold_and_targets_are_near_end_to_end(spark):
    """Over many seeds every document of a source is taken as often as its share asks, and the source comes near its target."""
    rng = random.Random(2)
    rows = [(100 * k + i, " ".join(["w"] * int(min(150, rng.paretovariate(0.9) * 10))), f"s{k:03}") for k in range(3) for i in range(60)]
    docs = spark.createDataFrame([(d, t, None, s, 0, "c", 7, "c") for d, t, s in rows], SCHEMA).coalesce(1).cache()
    taken, off, rounds = defaultdict(float), [], 16
    for seed in range(rounds):
        words, want, largest = defaultdict(int), {}, defaultdict(int)
        for r in mixing.mix(docs, bucket_rows=25, fan_in=2, seed=seed).collect():
            taken[r["doc_id"], r["target"] / r["source_size"]] += r["copies"] / rounds
            words[r["source"]] += r["copies"] * r["size"]
            want[r["source"]] = r["target"]
        off += [abs(words[s] - want[s]) / want[s] for s in want]
    free = [(share, n) for (_, share), n in taken.items() if share % 1 > 0.02]
    assert len(free) > 100
    worst = max(abs(n - share) / max(0.05, (share % 1 * (1 - share % 1) / rounds) ** 0.5) for share, n in free)
    assert worst < 4.5 and abs(sum(n - share for share, n in free)) / len(free) < 0.03
    assert np.mean(off) < 0.03 and max(off) < 0.15


def targets(spark, sizes, weights=(5, 2, 1)):
    rows = spark.createDataFrame([(f"s{i:05}", s, 1) for i, s in enumerate(sizes)], "source string, size long, n long")
    return [r["target"] for r in mixing.source_targets(rows, weights).orderBy("sid").collect()]


def test_targets_reshare_until_none_is_above(spark):
    assert targets(spark, [10, 1, 1000]) == [30.0, 3.0, 978.0]
    assert targets(spark, []) == [] and targets(spark, [0, 0]) == [0.0, 0.0]


def test_many_sources_are_numbered_in_order(spark):
    rng = random.Random(1)
    sizes = [int(rng.paretovariate(0.7) * 10) for _ in range(3000)]
    assert targets(spark, sizes) == pytest.approx(targets_plainly(sizes), rel=1e-6)
