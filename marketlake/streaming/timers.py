"""State with event-time timers: entries that run out, and the countdown to calendar events.

A timer fires when the watermark passes it, in whatever batch that happens; what is due between two
rows of one batch is found between those rows. So results depend on event times and on the last
watermark only, not on how rows fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """State with timers needs the store that keeps column families; a session's own choice of it stays."""
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)


class Expiry(StatefulProcessor):
    """State: the last entry of the key and its time to live, in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "t long, ttl long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows), ignore_index=True).sort_values("t", kind="stable")
        t, ttl = d["t"].to_numpy("int64"), d["ttl"].to_numpy("int64")
        if self.entry.exists():
            last = self.entry.get()
            # a row that comes late renews nothing
            later = t >= last[0]
            t, ttl = np.append(last[0], t[later]), np.append(last[1], ttl[later])
        gone = np.flatnonzero(t[1:] - t[:-1] > ttl[:-1])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.entry.update((int(t[-1]), int(ttl[-1])))
        self.handle.registerTimer(max(-(-int(t[-1] + ttl[-1]) // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield self._rows(key, t[gone], ttl[gone])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            t, ttl = self.entry.get()
            self.entry.clear()
            yield self._rows(key, np.array([t]), np.array([ttl]))

    @staticmethod
    def _rows(key, t: np.ndarray, ttl: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(t), dtype=object), "written": t, "expired": t + ttl})

    def close(self) -> None:
        pass


def expirations(rows: DataFrame, key: Column, ttl_seconds: Column, delay: str = "10 seconds") -> DataFrame:
    """(key, written, expired), in microseconds, of every entry that is not written again within its time to live.

    An entry between two rows of its key runs out when the next one comes too late; the last one when the
    watermark passes. ``rows`` has the event time ``ts``."""
    use_timers(rows.sparkSession)
    r = rows.withWatermark("ts", delay).select("ts", key.cast("string").alias("key"), F.unix_micros("ts").alias("t"), (ttl_seconds.cast("long") * 1_000_000).alias("ttl"))
    return r.groupBy("key").transformWithStateInPandas(Expiry(), "key string, written long, expired long", "Append", "EventTime")


class Countdown(StatefulProcessor):
    """State: of each event of the bucket its id, its second, the next second that has not been counted, and when
    that is due. A bucket has one timer, at the earliest due time; a call works on all that is due by then."""

    def __init__(self, before: int, after: int) -> None:
        self.before, self.after = before, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getValueState("events", "id array<long>, at array<long>, next array<long>, due array<long>")

    def _pending(self) -> dict:
        return {k: x for k, *x in zip(*self.events.get(), strict=True)} if self.events.exists() else {}

    def _keep(self, pending: dict) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not pending:
            self.events.clear()
            return
        at, start, due = (list(x) for x in zip(*pending.values(), strict=True))
        self.events.update((list(pending), at, start, due))
        self.handle.registerTimer(min(due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest: dict = {}
        for d in rows:
            d = d[d["at"].notna()]
            for event, at in zip(d["event_id"].tolist(), d["at"].astype("int64").tolist(), strict=True):
                event = None if event is None or event != event else int(event)
                latest[event] = max(at, latest.get(event, at))
        if not latest:
            return
        pending, now = self._pending(), timerValues.getCurrentWatermarkInMs()
        for event, at in latest.items():
            # an event that is moved is counted on from where the count stands
            start = max(at - self.before, pending[event][1]) if event in pending else at - self.before
            pending[event] = [at, start, max(start * 1000, now + 1)]
        self._keep(pending)
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending, now, found = self._pending(), timerValues.getCurrentWatermarkInMs(), []
        for event, (at, start, due) in list(pending.items()):
            if due > now:
                continue
            stop = min(now // 1000, at + self.after) + 1
            if stop > at + self.after:
                del pending[event]
            else:
                pending[event] = [at, stop, stop * 1000]
            parts = [("PRE_NEWS", start, min(stop, at)), ("NEWS_WINDOW", max(start, at), stop)]
            found += [(event, phase, x, y, at) for phase, x, y in parts if x < y]
        self._keep(pending)
        yield self._rows(found)

    @staticmethod
    def _rows(found: list) -> pd.DataFrame:
        d = pd.DataFrame(found, columns=["event_id", "phase", "first", "stop", "at"])
        return d.astype({"event_id": "Int64", "phase": object, "first": "int64", "stop": "int64", "at": "int64"})

    def close(self) -> None:
        pass


def countdown_stream(calendar: DataFrame, before: int = 900, after: int = 300, delay: str = "10 seconds", buckets: int = 512) -> DataFrame:
    """(event_id, phase, first, stop, at): stretches of seconds that the watermark has passed, of HIGH events.

    An event is known ``before`` seconds ahead, which is its place in event time; events of other impact move
    the watermark only. A row stands for the seconds first <= s < stop, so its number grows with batches, not
    with seconds; ``countdown_seconds`` spreads them. State and timers are kept by bucket of events, so that calls
    grow with buckets and batches, not with events."""
    use_timers(calendar.sparkSession)
    c = calendar.withColumn("ts", F.col("scheduled_time") - F.expr(f"INTERVAL {before} SECONDS")).withWatermark("ts", delay)
    # a filter would be pushed below the watermark, which all events are to move
    c = c.select("ts", "event_id", F.when(F.col("impact") == "HIGH", F.unix_seconds("scheduled_time")).alias("at"))
    c = c.withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets)))
    return c.groupBy("bucket").transformWithStateInPandas(Countdown(before, after), "event_id long, phase string, first long, stop long, at long", "Append", "EventTime")


def countdown_seconds(stretches: DataFrame) -> DataFrame:
    """A row for each second: (event_id, phase, second, to_event)."""
    s = stretches.select("event_id", "phase", "at", F.explode(F.sequence("first", F.col("stop") - 1)).alias("second"))
    return s.select("event_id", "phase", "second", (F.col("at") - F.col("second")).alias("to_event"))
