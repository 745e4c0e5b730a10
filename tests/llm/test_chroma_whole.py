import numpy as np

from quire.llm import chroma
from test_chroma import frame, tune


def test_equal_short_and_steady_recordings_link(spark):
    short, silence = tune(1, 0.1)[:500], np.full(9000, 128, np.uint8)
    rows = [(20, short), (21, short), (None, short), (40, silence), (41, silence), (42, silence), (60, tune(5, 0.1)[:480]), (80, None), (81, None)]
    got = {r["rec_id"]: (r["n_links"], r["best_id"], r["best_offset"], r["best_error"]) for r in chroma.search(chroma.fingerprints(frame(spark, rows))).collect()}
    assert got == {20: (2, 21, 0, 0.0), 40: (2, 41, 0, 0.0), 60: (0, None, None, None), 80: (0, None, None, None)}


def test_repeated_parts_align_by_bit_error_alone(spark):
    """Recording C V1 C V2, clip C V2."""
    c, v1, v2 = tune(1, 1.6), tune(2, 1.0), tune(3, 0.8)
    rows = [(20, np.concatenate([c, v2])), (21, np.concatenate([c, v1, c, v2])), (22, tune(7)), (40, np.tile(tune(8, 0.2), 9)), (41, np.tile(tune(8, 0.2), 12))]
    prints = {d: chroma.fingerprint(a) for d, a in rows}
    want = {}
    for d in (20, 40):
        q, found = prints[d], []
        for r, p in prints.items():
            ends = [(*chroma.bit_error(p, q, o), o) for o in range(1 - len(q), len(p)) if r != d]
            good = [(e, abs(o), o) for e, n, o in ends if e <= 0.2 and n >= max(8, 0.6 * min(len(p), len(q)))]
            found += [(min(good)[0], r, min(good)[2])] if good else []
        want[d] = (len(found), *min(found)[1:])
    got = {r["rec_id"]: (r["n_links"], r["best_id"], r["best_offset"]) for r in chroma.search(chroma.fingerprints(frame(spark, rows))).collect()}
    assert got == want and want[20][:2] == (1, 21)


def test_correlation_counts_as_expansion_does():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, 700).astype(np.uint32), rng.integers(0, 3, 400).astype(np.uint32)
    index = chroma.Index([b])
    got = [sorted(o for _, _, x in index.candidates([a], most) for o in x.tolist()) for most in (10, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) > 900
