"""Inactivity of keyed events: a streaming query with state and timers, and its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stuck_batch(events: DataFrame, key: str, ts: str, timeout_s: int) -> DataFrame:
    """(key, last_seen, resumed): gaps of more than ``timeout_s`` seconds between successive events of a key.

    The key's last event makes no gap. Events with null key or time are left out.
    """
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    w = W.partitionBy(key).orderBy(ts, *(["event_id"] if "event_id" in events.columns else []))
    g = e.select(key, F.col(ts).alias("last_seen"), F.lead(ts).over(w).alias("resumed"))
    return g.where(F.col("resumed") > F.col("last_seen") + F.expr(f"interval {timeout_s} seconds"))


class Stuck(StatefulProcessor):
    """Keeps the time of a key's last event; fires when nothing new came for the timeout in event time."""

    def __init__(self, timeout_s: int):
        self.timeout_s = timeout_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        times = sorted(t for r in rows for t in r["ts"].astype("datetime64[ms]").astype("int64"))
        before, told = self.last.get() if self.last.exists() else (None, True)
        old, out = before, []
        for t in map(int, times):
            if old is None or t > old:
                if old is not None and t - old > self.timeout_s * 1000 and not told:
                    out.append(old)  # the gap ended before its timer was due
                old, told = t, False
        if old != before:
            if before is not None:
                self.handle.deleteTimer(before + self.timeout_s * 1000)
            self.last.update((old, False))
            self.handle.registerTimer(old + self.timeout_s * 1000)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        ms, told = self.last.get()
        self.last.update((ms, True))
        yield self._rows(key, [] if told else [ms])

    @staticmethod
    def _rows(key, ms: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(ms), dtype="int64"), "last_seen": pd.to_datetime(pd.Series(ms, dtype="int64"), unit="ms")})

    def close(self) -> None:
        pass


def stuck_stream(events: DataFrame, key: str, ts: str, timeout_s: int, delay: str = "1 hour") -> DataFrame:
    """(key, last_seen): keys of a stream without events for ``timeout_s`` seconds of event time.

    Needs the RocksDB state store. Late events within ``delay`` count.
    """
    e = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and ts is not null").withWatermark("ts", delay)
    return e.groupBy("key").transformWithStateInPandas(Stuck(timeout_s), "key long, last_seen timestamp", "append", "EventTime")
