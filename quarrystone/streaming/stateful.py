"""Streams that keep state by key: idle sessions by timers, a reorder buffer in event time, and retries with dead letters."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: State with timers and maps lives in this store; the session must name it before a stream with state begins.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _frame(rows: list[tuple], columns: list[str], kinds: dict[str, str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({c: k for c, k in kinds.items() if c in columns})


class IdleSessions(StatefulProcessor):
    """A session of a key ends when nothing has come for ``idle_ms``.

    In event time a later event closes the session before it, and the
    watermark closes one that no event follows; a row that comes late by the
    watermark is not seen.  In processing time the clock closes it, and state
    of keys that are never heard of again is dropped after ``keep_ms``.
    """

    def __init__(self, idle_ms: int, event_time: bool, keep_ms: int | None = None):
        self.idle_ms, self.event_time, self.keep_ms = idle_ms, event_time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_us long, last_us long, last_id long, events long, timer_ms long", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = [(int(r.us), int(r.event_id)) for part in rows for r in part.itertuples()]  # one micro-batch of one key
        held = self.open.get() if self.open.exists() else None
        out, now = [], timerValues.getCurrentProcessingTimeInMs()
        first, last, last_id, events, timer = tuple(held) if held is not None else (None, None, None, 0, None)
        for us, event_id in sorted(parts):
            if self.event_time and last is not None and us - last > self.idle_ms * 1000:
                out.append((*key, last_id, first, last, events, "gap"))
                first, events = None, 0
            first = us if first is None else min(first, us)
            if last is None or (us, event_id) > (last, last_id):
                last, last_id = us, event_id
            events += 1
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (last // 1000 if self.event_time else now) + self.idle_ms + 1
        self.handle.registerTimer(timer)
        self.open.update((first, last, last_id, events, timer))
        yield self.rows(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        self.open.clear()
        yield self.rows([] if held is None else [(*key, held[2], held[0], held[1], held[3], "timer")])

    def rows(self, out: list[tuple]) -> pd.DataFrame:
        return _frame(out, ["user_id", "last_id", "first_us", "last_us", "events", "closed_by"], dict.fromkeys(("user_id", "last_id", "first_us", "last_us", "events"), "int64"))

    def close(self) -> None:
        pass


_SESSION = "user_id long, last_id long, first_us long, last_us long, events long, closed_by string"


def idle_sessions(events: DataFrame, idle: str, event_time: bool = True, keep: str | None = None) -> DataFrame:
    """(user_id, last_id, first_us, last_us, events, closed_by) of each session of a stream (user_id, event_id, ts) that has been idle for longer than ``idle``.

    ``events`` has a watermark on ``ts`` if ``event_time``.  ``keep`` is the
    time to live of a silent key's state, for processing time.
    """
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    if not event_time:
        ttl = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
        rows = events.select("user_id", "event_id", F.unix_micros("ts").alias("us"))
        return rows.groupBy("user_id").transformWithStateInPandas(IdleSessions(ms, False, ttl), _SESSION, "Append", "ProcessingTime")
    rows = events.select("user_id", "event_id", F.unix_micros("ts").alias("us"), "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(IdleSessions(ms, True), _SESSION, "Append", "EventTime")


#: Keys that a stream keeps state for are dealt into so many groups; each group's state is read and written at once.
GROUPS = 1024


def _group(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(GROUPS)).alias("group")


def _packed(frame: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


class Reorder(StatefulProcessor):
    """Rows leave in order of (us, event_id) once none can come before them; a row later than ``late_us`` leaves at once, marked.

    A group of users has a list of the frames that wait, what number each user
    has come to, and one timer, for the first row that is due.  A row is late by
    its own times, not by what came before it, so any cut into micro-batches
    gives the same.
    """

    def __init__(self, late_us: int):
        self.late_us = late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.place = handle.getValueState("place", "users binary, counts binary, due long")

    def due(self, us: Any) -> Any:
        """The millisecond of the watermark that is surely past the last row that may come before one of ``us``."""
        return (us + self.late_us) // 1000 + 1

    def places(self) -> tuple[bytes, bytes, int]:
        return tuple(self.place.get()) if self.place.exists() else (b"", b"", -1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        users, counts, due = self.places()
        first = due
        for part in rows:
            late = part["arrived_us"] - part["us"] > self.late_us
            held = part.loc[~late, ["user_id", "us", "event_id", "payload"]]
            if len(held):
                self.waiting.appendValue((_packed(held),))
                low = int(self.due(held["us"].min()))
                first = low if first < 0 else min(first, low)
            yield self.rows(part[late], None)
        if first != due:
            if due >= 0:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            self.place.update((users, counts, first))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = pd.concat([_unpacked(r[0]) for r in self.waiting.get()], ignore_index=True)
        is_ready = self.due(held["us"]) <= now
        ready, rest = held[is_ready].sort_values(["user_id", "us", "event_id"]), held[~is_ready]
        users, counts, _ = self.places()
        known = pd.Series(np.frombuffer(counts, np.int64), np.frombuffer(users, np.int64))
        pos = ready.groupby("user_id").cumcount() + 1 + ready["user_id"].map(known).fillna(0).astype("int64")
        known = known.add(ready.groupby("user_id").size(), fill_value=0).astype("int64")
        following = int(self.due(rest["us"].min())) if len(rest) else -1
        if len(rest):
            self.waiting.put([(_packed(rest),)])
            self.handle.registerTimer(following)
        else:
            self.waiting.clear()
        self.place.update((known.index.to_numpy(np.int64).tobytes(), known.to_numpy(np.int64).tobytes(), following))
        yield self.rows(ready, pos)

    def rows(self, found: pd.DataFrame, pos: pd.Series | None) -> pd.DataFrame:
        numbers = pd.array([pd.NA] * len(found), "Int64") if pos is None else pos.astype("Int64")
        return pd.DataFrame({"user_id": found["user_id"], "event_id": found["event_id"], "pos": numbers, "late": pos is None, "payload": found["payload"]})

    def close(self) -> None:
        pass


def reorder(events: DataFrame, late: str) -> DataFrame:
    """(user_id, event_id, pos, late, payload) of a stream (user_id, event_id, ts, arrived, payload) whose rows arrive out of order.

    The watermark runs over ``arrived``.  Rows of a user leave in order of
    (ts, event_id), numbered from 1; rows that arrive over ``late`` after their
    time leave unnumbered, for a side table.
    """
    us = int(pd.Timedelta(late).total_seconds() * 1e6)
    rows = events.withWatermark("arrived", "0 seconds").select(_group("user_id"), "user_id", "event_id", F.unix_micros("ts").alias("us"), F.unix_micros("arrived").alias("arrived_us"), "arrived", "payload")
    return rows.groupBy("group").transformWithStateInPandas(Reorder(us), "user_id long, event_id long, pos long, late boolean, payload string", "Append", "EventTime")


class Attempts(StatefulProcessor):
    """Counts a message's failed attempts: the first ``most`` - 1 go to be tried again, the next to the dead letters; a success ends it.

    The state is one table for a group of messages, in order of message.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "messages binary, failures binary, last_seqs binary, ended binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = pd.concat([part[["message", "seq", "failed"]] for part in rows], ignore_index=True)
        parts["failed"] = parts["failed"].eq(True)
        raws = self.seen.get() if self.seen.exists() else [b""] * 4
        held = pd.DataFrame({c: np.frombuffer(raw, kind) for c, raw, kind in zip(("failures", "last", "ended"), raws[1:], (np.int64, np.int64, np.bool_))}, index=pd.Index(np.frombuffer(raws[0], np.int64), name="message"))
        parts = parts.sort_values(["message", "seq", "failed"]).drop_duplicates(["message", "seq"]).join(held, on="message")
        # told before, or settled: at-least-once input changes nothing
        parts = parts[~parts["ended"].eq(True) & ~(parts["seq"] <= parts["last"].fillna(-1))]
        parts["failures"] = parts["failures"].fillna(0).astype("int64") + parts.groupby("message")["failed"].cumsum().astype("int64")
        parts["ended"] = ~parts["failed"] | (parts["failures"] >= self.most)
        parts = parts[parts.groupby("message")["ended"].cumsum() - parts["ended"] == 0]
        parts["route"] = np.where(~parts["failed"], "done", np.where(parts["ended"], "dead", "retry"))
        newest = parts.groupby("message").tail(1).set_index("message")[["failures", "seq", "ended"]].rename(columns={"seq": "last"})
        held = pd.concat([held[~held.index.isin(newest.index)], newest]).sort_index()
        self.seen.update((held.index.to_numpy(np.int64).tobytes(), *[held[c].to_numpy(kind).tobytes() for c, kind in (("failures", np.int64), ("last", np.int64), ("ended", np.bool_))]))
        yield parts[["message", "seq", "failures", "route"]]

    def close(self) -> None:
        pass


def route_attempts(attempts: DataFrame, most: int) -> DataFrame:
    """(message, seq, failures, route) of a stream (message, seq, failed) of attempts: done, retry, or dead at the ``most``-th failure; what follows an end is left out."""
    return attempts.select(_group("message"), "message", "seq", "failed").groupBy("group").transformWithStateInPandas(Attempts(most), "message long, seq long, failures long, route string", "Append", "None")


def two_sinks(routed: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Retries and dead letters to a table each.

    A micro-batch's files go to folders of its number, which a replay
    overwrites; then one small file names the batch, and ``read_routed`` reads
    named batches only.  So a batch is in both tables or in neither, and once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        for route in ("retry", "dead"):
            batch.where(F.col("route") == route).write.mode("overwrite").parquet(f"{folder}/{route}/batch={number}")
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits/{number}")
        done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()
        batch.unpersist()

    return routed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_routed(spark: SparkSession, folder: str, route: str) -> DataFrame:
    """The rows of a route in committed batches."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted(int(x.getPath().getName()) for x in store.listStatus(root)) if store.exists(root) else []
    if not done:
        return spark.createDataFrame([], "message long, seq long, failures long, route string")
    return spark.read.parquet(*[f"{folder}/{route}/batch={n}" for n in done])
