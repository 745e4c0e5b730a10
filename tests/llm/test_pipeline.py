import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from test_repeats import plain_words
from test_simhash import plain as plain_components

import corpus_pipeline
from quire.llm import mixing, simhash
from test_mixing import targets_plainly

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(8)
    kinds = {"xa": "abcdefg", "xb": "hijklmé"}
    word = {g: ["".join(rng.choice(s) for _ in range(rng.randint(2, 8))) for _ in range(400)] for g, s in kinds.items()}
    text = lambda g, n: " ".join(rng.choice(word[g]) for _ in range(n))
    rows = []
    for i in range(240):
        g = rng.choice(list(kinds))
        rows.append((i, text(g, rng.randint(4, 150)), g, f"s{min(4, i % 9)}" if i % 11 else None, 0))
    passage = text("xa", 90)
    for i in (3, 50, 91):
        rows[i] = (i, rows[i][1] + " " + passage + " " + text("xa", 20), *rows[i][2:])
    rows += [(300 + i, rows[i][1], "xa", "s0", 0) for i in range(30)] + [(400, None, None, "s1", 0), (401, "", None, None, 0), (402, "1234 !!", None, "s1", 0), (5, *rows[5][1:])]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    out, docs = [spark.read.parquet(f"{folder}/documents.parquet")], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return folder, [d.collect() for d in out], out


def test_names_and_columns(stages):
    _, _, frames = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "mixing", "token_ids"]
    assert all(f.columns == frames[0].columns for f in frames[:-1])


def test_language_drops_what_has_none(stages):
    _, (before, after, *_), _ = stages
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {400, 401, 402}


def test_one_of_each_group_stays(stages):
    _, (_, before, after, *_), _ = stages
    groups = plain_components([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in groups})
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()


def test_passages_are_cut(stages):
    _, (_, _, before, after, *_), _ = stages
    want = {r["doc_id"]: t for r, t in zip(before, plain_words([r["text"] for r in before], 51))}
    old = {r["doc_id"]: r["text"] for r in before}
    cut = 0
    for r in after:
        assert r["text"] == want[r["doc_id"]]
        cut += r["text"] != old[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    assert len(after) == len(before) and cut >= 3


def test_sources_meet_their_targets(stages, spark):
    _, (_, _, _, before, after, _), frames = stages
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, most, taken, copies = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        total[r["source"]] += size(r["text"])
        most[r["source"]] = max(most[r["source"]], size(r["text"]))
    for r in after:
        taken[r["source"]] += size(r["text"])
        copies[r["doc_id"]] += 1
    names = sorted(total, key=lambda s: (s is None, s or ""))
    for s, target in zip(names, targets_plainly([total[s] for s in names])):
        assert abs(taken[s] - target) <= most[s]
    assert max(copies.values()) <= 3
    again = mixing.apply_mix(frames[3]).collect()
    assert sorted(map(str, again)) == sorted(map(str, after))


def test_ids_round_trip(stages):
    from tokenizers import Tokenizer

    from quire.llm.queries import tokenizer_path

    _, (*_, before, after), _ = stages
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    want = sorted((r["doc_id"], tuple(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in before)
    assert sorted((r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in after) == want
    assert all(r["decoded_sha256"] == hashlib.sha256(t.decode(np.frombuffer(bytes(r["ids"]), "<u4").tolist(), skip_special_tokens=False).encode()).hexdigest() for r in after)


def test_run_is_the_stages(stages, spark):
    folder, out, _ = stages
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, out[-1]))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0




def test_extra_columns_and_very_long_texts_pass_all_stages(spark, tmp_path):
    """Columns named as the operators' own, some repeated in other case or with blanks, and texts of 200,000 words, one of them null elsewhere."""
    rng = random.Random(5)
    word = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(word) for _ in range(n))
    passage = text(70)
    rows = [(i, text(40) + (" " + passage + " " + text(9) if i < 2 else ""), "xa", "s0", 0) for i in range(30)]
    rows += [(100, text(200_000), "xa", "s1", 0), (101, text(100_000) + " " + passage + " " + text(100_000), "xa", "s1", None), (None, None, None, None, None)]
    extra = ["tid", "_key", "_letters", "_t1", "_t2", "_spans", "_size", "_copies", "_n", "_d", "spans", "t1", "rid", "copies", "odd name", "cls"]
    docs = spark.createDataFrame([(*r, *[f"{x}{r[0]}" for x in extra]) for r in rows], SCHEMA + "".join(f", `{x}` string" for x in extra))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        assert at.columns == docs.columns
        found = at.collect()
        assert all(r[x] == f"{x}{r['doc_id']}" for r in found for x in extra)
        if name == "repeated_passages":
            assert {r["doc_id"] for r in found} == {r[0] for r in rows} - {None} and not any(passage in r["text"] for r in found)
            assert {r["doc_id"]: len(r["text"].split()) for r in found}[101] == 200_000
    last = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert len(last) == len(found) and max(r["n_tokens"] for r in last) > 200_000


def test_tables_of_other_queries_stay(spark, tmp_path):
    """A query that is built before the pipeline and read after it."""
    rows = [(i, f"the quick brown fox number {i % 7} jumps over the lazy dog", "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    query = simhash.near_duplicates(docs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert query.count() == 40
