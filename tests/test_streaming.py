"""Streams against the batch answer over the same rows, arriving shuffled and in several triggers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import discover
from quire.streaming import frontier, ordered, pages

T = dt.datetime(2024, 1, 1)


def in_files(spark, rows, schema, folder):
    """A file per trigger, rows in the order given."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def drained(df, name, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return df.sparkSession.table(name).collect()


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def shuffled(rows, parts, seed):
    """Rows dealt to triggers out of order by some places, never by more than the watermark's delay."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[-1].timestamp() + rng.random() * 20)
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_capped_duplicates_arrive_in_any_order(spark, few_partitions, tmp_path):
    rng = random.Random(3)
    rows = [(b, i, f"h{rng.randint(0, 12)}", rng.random() < 0.9, T + dt.timedelta(seconds=3 * i)) for b in ("x", "y") for i in range(40)]
    end = [("z", 0, "h", True, T + dt.timedelta(days=1))]
    want, cap = {}, 15
    for b in ("x", "y"):
        seen = set()
        for n, (_, i, h, filled, _) in enumerate([r for r in rows if r[0] == b], 1):
            want[b, i] = n <= cap and filled and h in seen
            if n <= cap and filled:
                seen.add(h)
    schema = "book_id string, seq long, content_hash string, filled boolean, ts timestamp"
    source = in_files(spark, [*shuffled(rows, 4, 1), end], schema, tmp_path / "in")
    got = drained(ordered.capped_duplicates(source, cap, "60 seconds"), "capped", tmp_path)
    assert len(got) == len(rows) and {(r["book_id"], r["seq"]): r["duplicate"] for r in got} == want
    assert any(want.values())


def test_trailing_counts_equal_the_batch_windows(spark, few_partitions, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 3), T + dt.timedelta(seconds=rng.choice([0, 0, 1, 7, 30]) + 4 * i)) for i in range(60)]
    rows += [(1000 + i, 1, rows[5][2]) for i in range(3)]  # equal times
    schema = "event_id long, user_id long, ts timestamp"
    end = [(9999, 9, T + dt.timedelta(days=1))]
    batch = pages.stability(spark.createDataFrame(rows, schema), "user_id", 40, 4)
    want = {r["event_id"]: (r["recent"], r["stable"]) for r in batch.collect()}
    source = in_files(spark, [*shuffled(rows, 4, 2), end], schema, tmp_path / "in")
    got = drained(ordered.trailing_counts(source, "user_id", 40, 4, "60 seconds"), "trailing", tmp_path)
    assert {r["event_id"]: (r["recent"], r["stable"]) for r in got} == want and len(got) == len(want)


PAGES = "page_id long, url string, html string"


def site(host, n, last=None):
    nav = lambda i: f'<a href="/post/{i}">p</a><a href="/post/shared">s</a>' + (f'<a class="next" href="/list{i + 1}">Next</a>' if i < n else last or "")
    return [(i, f"https://{host}/list{i}", f"<body>{nav(i)}</body>") for i in range(1, n + 1)]


def state(f):
    return sorted(map(tuple, f.chain().collect())), sorted(map(tuple, f.links().collect()))


def test_frontier_goes_on_as_captures_arrive(spark, tmp_path):
    rows = site("a.com", 6) + [(100 + i, u, h) for i, u, h in site("b.com", 3, '<a class="next" href="/list1">Next</a>')] + [(900, "https://c.com/", "<p>x</p>"), (901, None, "x"), (902, "https://a.com/post/1", None)]
    seeds = spark.createDataFrame([("a.com", "https://a.com/list1"), ("b.com", "https://b.com/list1"), ("b.com", "https://b.com/list1"), ("d.com", "https://d.com/never")], "book_id string, url string")
    whole = spark.createDataFrame(rows, PAGES)
    want = (
        sorted(map(tuple, discover.pagination_chain(seeds, discover.next_links(whole)).collect())),
        sorted(map(tuple, discover.discover(whole, seeds).collect())),
    )
    f = frontier.Frontier(spark, str(tmp_path / "f"), seeds)
    parts = [[r for i, r in enumerate(rows) if i % 3 == k] for k in (2, 0, 1)]  # later pages of a chain come first
    counts = []
    for n, part in enumerate(parts):
        f.process(spark.createDataFrame(part, PAGES), n)
        counts.append(f.chain().count())
    assert state(f) == want and counts[0] < counts[-1]
    f.process(spark.createDataFrame(parts[-1], PAGES), 2)  # the last batch again, as after a failure
    assert state(f) == want
    f.process(spark.createDataFrame([(1, "https://a.com/list1", "<body>other</body>")], PAGES), 3)  # a later capture of what is known
    assert state(f) == want


def test_frontier_follows_a_stream_and_restarts(spark, tmp_path):
    rows = site("a.com", 4)
    seeds = spark.createDataFrame([("a.com", "https://a.com/list1")], "book_id string, url string")
    where, f = str(tmp_path / "pages"), frontier.Frontier(spark, str(tmp_path / "f"), seeds)
    depth = []
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, PAGES).coalesce(1).write.mode("append").parquet(where)
        source = spark.readStream.schema(PAGES).parquet(where)
        assert frontier.Frontier(spark, str(tmp_path / "f"), seeds).start(source, str(tmp_path / "c")).awaitTermination(120)
        depth.append(f.chain().agg(F.max("depth")).first()[0])
    assert depth == [3, 4]  # the second page names a third that was not there yet
    assert [r["href"] for r in f.links().orderBy("seq").collect()][:2] == ["https://a.com/post/1", "https://a.com/post/shared"]


class State:
    """A value or a list of state; how many values a list holds shows what a group costs."""

    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return iter(self.v) if isinstance(self.v, list) else self.v

    def update(self, v):
        self.v = v

    def put(self, v):
        self.v = list(v)

    def appendList(self, v):
        self.v = (self.v or []) + list(v)

    def clear(self):
        self.v = None


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getListState(self, name, schema):
        return self.states.setdefault(name, State())

    getValueState = getListState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_users_of_a_bucket_share_a_group_and_its_state(monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(ordered, "PIECE_ROWS", 400)
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"at": rng.integers(1, 60_000, 1000) * 1000, "event_id": np.arange(1000), "x": rng.integers(0, 40, 1000), "y": rng.integers(0, 2, 1000)})
    t, handle, out = ordered.Trailing(5, 2), Handle(), []
    t.init(handle)
    assert list(t.handleInputRows((0,), iter([rows[:500], rows[500:]]), None)) == []
    assert len(handle.states["buffer"].v) == 3 and len(handle.timers) == 1  # a thousand rows of some eighty users
    for mark in (30_000, 60_000):
        handle.timers.clear()
        out += t.handleExpiredTimer((0,), Mark(mark), None)
        assert len(handle.timers) == 1
    got = pd.concat(out).set_index("event_id").sort_index()
    want = [((rows.x == r.x) & (rows.y == r.y) & (rows["at"] <= r.at) & (rows["at"] >= r.at - 5_000_000)).sum() for r in rows.itertuples()]
    assert list(got["recent"]) == want and list(got["stable"]) == [n <= 2 for n in want]
    last = handle.timers.pop()
    assert list(t.handleExpiredTimer((0,), Mark(last), None)) == [] and not handle.timers and not any(s.exists() for s in handle.states.values())
