"""Streams whose rows arrive in any order and are treated in order: each key buffers its rows until the watermark has passed them.

What comes out equals the batch answer over all rows that arrive within the watermark's delay, in whatever triggers. A book, or a bucket
of users, is one task's work; it holds what the delay spans and its own small state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.sources.staging import claimed

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Users share so many groups, as each group costs some dozen messages between Spark and Python in a trigger.
BUCKETS = 512
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

#: Rows of a piece of state at most.
PIECE_ROWS = 65_536


def _kept(rows: pa.Table) -> list[tuple[bytes]]:
    """Rows as values of a list of "rows binary": a piece is one value, as state is told value by value."""
    out = []
    for at in range(0, len(rows), PIECE_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_table(rows.slice(at, PIECE_ROWS))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _held(state, schema: pa.Schema) -> pa.Table:
    """What _kept() made of rows, back from a list of state."""
    got = [pa.ipc.open_stream(r[0]).read_all() for r in state.get()] if state.exists() else []
    return pa.concat_tables(got) if got else schema.empty_table()


class InOrder(StatefulProcessor):
    """Buffers rows with their event time in microseconds (at), and hands those that the watermark has passed to release().

    One timer a group, at its earliest buffered row. release() gives what is put out and when to wake the group if no row is left, to drop state.
    """

    row = "at long, seq long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "rows binary")
        self.due = handle.getValueState("due", "ms long")
        self.schema = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in self.row.split(", "))])

    def _wake(self, ms: int | None) -> None:
        """Sets the group's timer, or none."""
        now = self.due.get()[0] if self.due.exists() else None
        if ms == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if ms is None:
            self.due.clear()
        else:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables(pa.Table.from_pandas(x[self.schema.names], self.schema, preserve_index=False) for x in rows)
        self.buffer.appendList(_kept(new))
        first = -(-pc.min(new["at"]).as_py() // 1000)
        if not self.due.exists() or first < self.due.get()[0]:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = _held(self.buffer, self.schema)
        passed = pc.less_equal(held["at"], mark)
        ready, rest = held.filter(passed), held.filter(pc.invert(passed))
        if len(rest):
            self.buffer.put(_kept(rest))
        else:
            self.buffer.clear()
        self.due.clear()  # it has gone off
        out, again = self.release(key, ready, mark)
        self._wake(-(-pc.min(rest["at"]).as_py() // 1000) if len(rest) else again)
        if out is not None:
            yield out

    def release(self, key, rows: pa.Table, mark: int) -> tuple[pd.DataFrame | None, int | None]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Capped(InOrder):
    """Duplicates among the first `cap` articles of a book; a book's state is at most `cap` hashes and a count."""

    row = "at long, seq long, content_hash string, filled boolean"

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "n long")
        self.seen = handle.getMapState("seen", "content_hash string", "place long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.count.exists() and self.count.get()[0] >= self.cap:  # none that comes now is compared
            return iter([pd.DataFrame({"book_id": key[0], "seq": x["seq"], "duplicate": False}) for x in rows])
        return super().handleInputRows(key, rows, timerValues)

    def release(self, key, rows: pa.Table, mark: int) -> tuple[pd.DataFrame | None, int | None]:
        if not len(rows):
            return None, None
        rows = rows.sort_by([("seq", "ascending"), ("at", "ascending")])
        n = self.count.get()[0] if self.count.exists() else 0
        seen = {k[0] for k in self.seen.keys()} if self.seen.exists() else set()
        flags = []
        for h, filled in zip(rows["content_hash"].to_pylist(), rows["filled"].to_pylist(), strict=True):
            n += 1
            counts = n <= self.cap and filled
            flags.append(bool(counts and h in seen))
            if counts and h not in seen:
                seen.add(h)
                self.seen.updateValue((h,), (n,))
        self.count.update((n,))
        return pd.DataFrame({"book_id": key[0], "seq": rows["seq"].to_pylist(), "duplicate": flags}), None


class Trailing(InOrder):
    """How many events of a user the trailing window of each holds, for a bucket of users at a time; users are named by 128 bits (x, y).

    State is the times within one window, and goes once the watermark has left them.
    """

    row = "at long, event_id long, x long, y long"

    def __init__(self, seconds: int, threshold: int):
        self.width, self.threshold = seconds * 1_000_000, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "rows binary")

    def release(self, key, rows: pa.Table, mark: int) -> tuple[pd.DataFrame | None, int | None]:
        all_ = pa.concat_tables([rows.drop_columns("event_id"), _held(self.recent, rows.drop_columns("event_id").schema)])
        kept = all_.filter(pc.greater_equal(all_["at"], mark - self.width))
        if len(kept):
            self.recent.put(_kept(kept))
        else:
            self.recent.clear()
        again = (pc.max(kept["at"]).as_py() + self.width) // 1000 + 1 if len(kept) else None
        if not len(rows):
            return None, again
        at, x, y = (all_[c].to_numpy() for c in ("at", "x", "y"))
        user = np.unique(np.stack([x, y], 1), axis=0, return_inverse=True)[1].reshape(-1)
        own_at, own = at[: len(rows)], user[: len(rows)]
        times = np.unique(np.r_[at, own_at - self.width])  # a user's place and that of a time make one number to sort by
        place = lambda users, t: users * len(times) + np.searchsorted(times, t)
        sorted_ = np.sort(place(user, at))
        n = np.searchsorted(sorted_, place(own, own_at), "right") - np.searchsorted(sorted_, place(own, own_at - self.width), "left")
        return pd.DataFrame({"event_id": rows["event_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), "recent": n, "stable": n <= self.threshold}), again


def _clock(at: Column) -> Column:
    """The event time that the watermark follows: in whole milliseconds, as the watermark is, and never before the row's own."""
    return F.timestamp_millis(F.ceil(at / 1000).cast("long"))


def settled(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that its source holds now, and gives what it put out; its files are in the shared folder until they are released."""
    spark, folder = stream.sparkSession, claimed(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _in_order(rows: DataFrame, key: str, processor: InOrder, out: str) -> DataFrame:
    """Sets the session's state store to RocksDB, which such state needs."""
    spark: SparkSession = rows.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def capped_duplicates(articles: DataFrame, cap: int = 100, late: str = "1 hour") -> DataFrame:
    """(book_id, seq, duplicate) of a stream of articles(book_id, seq, content_hash, filled, ts): whether the first `cap` of a book hold the hash before, by seq.

    Articles may arrive in any order within `late` of the newest; ts has to grow with seq. The first `cap` are told once the watermark has
    passed them, later ones at once. Rows without a book or a time are left out, and those later than `late` are dropped, as are times up to 1970, where a watermark begins.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = articles.where("book_id is not null and ts is not null").select("book_id", "seq", "content_hash", F.coalesce("filled", F.lit(False)).alias("filled"), _clock(at).alias("ts"), at.alias("at"))
    rows = rows.withWatermark("ts", late)
    return _in_order(rows, "book_id", Capped(cap), "book_id string, seq long, duplicate boolean")


def trailing_counts(events: DataFrame, key: str, seconds: int = 3600, threshold: int = 5, late: str = "1 hour") -> DataFrame:
    """(event_id, recent, stable) of a stream of events(event_id, key, ts): stability() of the batch side, once the watermark has passed an event."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select("event_id", F.xxhash64(key).alias("x"), F.xxhash64(F.lit(1), key).alias("y"), _clock(at).alias("ts"), at.alias("at"))
    rows = rows.withColumn("bucket", F.pmod("x", F.lit(BUCKETS))).withWatermark("ts", late)
    return _in_order(rows, "bucket", Trailing(seconds, threshold), "event_id long, recent long, stable boolean")
