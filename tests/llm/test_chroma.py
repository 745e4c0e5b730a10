import numpy as np

from quire.llm import chroma


def tune(seed, seconds=2.0):
    rng = np.random.default_rng(seed)
    t = np.arange(int(chroma.RATE * 0.08)) / chroma.RATE
    notes = [np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * t) + 0.5 * np.sin(2 * np.pi * 330 * 2 ** (rng.integers(0, 12) / 12) * t) for _ in range(int(seconds / 0.08))]
    return np.clip(128 + 50 * np.concatenate(notes), 0, 255).astype(np.uint8)


def frame(spark, rows):
    return spark.createDataFrame([(d, None if a is None else bytearray(a.tobytes()), "clash", 1.0) for d, a in rows], "doc_id long, audio binary, rec_id string, fp double")


def plain_print(sound):
    """The fingerprint from its definition: pitch energies by a direct transform, rectangles summed cell by cell."""
    x = sound.astype(float)
    if len(x) == 0:
        return []
    x = np.pad(x, (0, max(0, chroma.FRAME - len(x))))
    hertz = np.arange(chroma.FRAME // 2 + 1) * chroma.RATE / chroma.FRAME
    wave = np.exp(-2j * np.pi * np.outer(np.arange(chroma.FRAME // 2 + 1), np.arange(chroma.FRAME)) / chroma.FRAME)
    image = []
    for at in range(0, len(x) - chroma.FRAME + 1, chroma.HOP):
        part = x[at : at + chroma.FRAME]
        power = np.abs(wave @ ((part - part.mean()) * np.hanning(chroma.FRAME)))
        row = np.zeros(12)
        for f, e in zip(hertz, power):
            if chroma.LOWEST <= f <= chroma.HIGHEST:
                row[round(12 * np.log2(f / 440)) % 12] += e
        image.append(row / max(1e-6, np.sqrt((row * row).sum())))
    image += [image[-1]] * max(0, chroma.SPAN - len(image))
    out = []
    for t in range(len(image) - chroma.SPAN + 1):
        bits = 0
        for k, (kind, p, tall, wide) in enumerate(chroma.FILTERS):
            q, mid, third = min(12, p + tall), p + max(1, min(12 - p, tall) // 2), max(1, wide // 3)
            a = b = 0.0
            for dt in range(wide):
                for c in range(p, q):
                    late, high, edge = dt >= wide // 2, c >= mid, dt < third or dt >= wide - third
                    first = [not late, not high, late == high, not edge][kind]
                    v = image[t + dt][c]
                    a, b = (a + v * (2 if kind == 3 else 1), b) if first else (a, b + v)
            change = np.log((1 + a) / (1 + b))
            level = int(change > -0.2) + int(change > 0) + int(change > 0.2)
            bits |= (level ^ (level >> 1)) << (2 * k)
        out.append(bits)
    return out


def plain(rows):
    """Every query against every row at every offset: equal ones, or enough agreeing pairs of integers and few differing bits."""
    prints = [(d, chroma.fingerprint(a if a is not None else np.zeros(0, np.uint8)).tolist()) for d, a in rows]
    out = []
    for d, q in prints:
        if d is None or d % 20:
            continue
        found = []
        for r, p in prints:
            if p == q:
                if r != d and q:
                    found.append((0.0, r is None, r or 0, 0))
                continue
            ends = []
            for o in range(1 - len(q), len(p)):
                lo, hi = max(0, -o), min(len(q), len(p) - o)
                if hi - lo < max(chroma.LEAST_OVERLAP, chroma.LEAST_SHARE * min(len(p), len(q))):
                    continue
                same = [p[i + o] == q[i] for i in range(lo, hi)]
                if sum(x and y for x, y in zip(same, same[1:])) < chroma.LEAST_HITS:
                    continue
                e = sum((p[i + o] ^ q[i]).bit_count() for i in range(lo, hi)) / (32 * (hi - lo))
                if e <= chroma.MOST_ERROR:
                    ends.append((e, abs(o), o))
            if ends:
                found.append((min(ends)[0], r is None, r or 0, min(ends)[2]))
        best = min(found, default=None)
        out.append((d, len(q), len(found), None if best is None or best[1] else best[2], best and best[3]))
    return sorted(out, key=str)


def corpus():
    rng = np.random.default_rng(9)
    rows = [(i, tune(i)) for i in range(45)]
    rows += [(101, rows[0][1]), (102, rows[20][1][64 * 5 :]), (103, np.clip(rows[40][1] + rng.normal(0, 2, len(rows[40][1])), 0, 255).astype(np.uint8)), (None, rows[0][1])]
    rows += [(200, tune(60)), (200, np.concatenate([tune(60), tune(61, 0.3)])), (200, tune(62)), (202, tune(62))]  # one id, different sound
    return rows + [(120, None), (140, np.zeros(0, np.uint8)), (160, np.full(9000, 128, np.uint8)), (180, tune(1, 0.2)), (20, rows[20][1])]


def test_alignments_match_brute_force(spark):
    rows = corpus()
    got = [(r["rec_id"], r["n_frames"], r["n_links"], r["best_id"], r["best_offset"]) for r in chroma.search(chroma.fingerprints(frame(spark, rows))).collect()]
    assert sorted(got, key=str) == plain(rows)
    named = {r[0]: r[3:] for r in got}
    assert named[0][0] == 101 and named[40][0] == 103 and len(got) == len([r for r in rows if r[0] is not None and r[0] % 20 == 0])


def test_blocks_change_nothing(spark):
    rows = corpus()
    whole = sorted(map(str, chroma.search(chroma.fingerprints(frame(spark, rows))).collect()))
    assert sorted(map(str, chroma.search(chroma.fingerprints(frame(spark, rows)), block_frames=100, group_frames=300).collect())) == whole


def test_empty_table(spark):
    assert chroma.search(chroma.fingerprints(frame(spark, []))).count() == 0


def test_integral_image_equals_sums():
    sound = tune(4, 1.0)
    fp = chroma.fingerprint(sound)
    assert len(fp) == (len(sound) - chroma.FRAME) // chroma.HOP + 1 - chroma.SPAN + 1
    assert np.mean([int(a).bit_count() for a in fp ^ np.array(plain_print(sound), np.uint32)]) < 0.05  # rounding apart
    assert len(chroma.fingerprint(sound[:300])) == len(plain_print(sound[:300])) == 1  # the same frame all along: differences of rounding
    assert len(np.unique(fp)) > 10 and chroma.bit_error(fp, fp, 0) == (0.0, len(fp))
