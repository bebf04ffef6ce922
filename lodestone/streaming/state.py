"""Histories and bursts of changes as state of a stream.

A file's history is a list in the state that holds its last entries and is forgotten some
time after its last change. A burst is flushed when no change follows in time, and the more
changes wait the shorter that time is; event-time timers do it, so a replayed stream gives
what ``operators.changes.dynamic_bursts`` gives for a table. Keys spread over all tasks.

Cases: events may come out of order within the watermark's delay, later ones are dropped;
rows that repeat are changes of their own; null times and null keys are dropped (no time
to judge by; no file); a burst stays open until the watermark passes its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.changes import flushed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State of several kinds needs this store; streams that start inside have it."""
    held = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, held) if held else spark.conf.unset(PROVIDER)


def _texts(values: list) -> pd.Series:
    """As plain objects, which every version of pandas hands on as one Arrow array."""
    return pd.Series(values, dtype=object)


class _History(StatefulProcessor):
    def __init__(self, most: int, ttl: int | None) -> None:
        self.most, self.ttl = most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "hash string, at timestamp", self.ttl) if self.ttl else handle.getListState("entries", "hash string, at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = [(h, at) for h, at in self.entries.get()]
        for r in rows:
            held += [(h, at.to_pydatetime()) for h, at in zip(r["hash"].tolist(), r["at"])]
        held.sort(key=lambda x: (x[1], x[0] or ""))
        held = held[-self.most :]
        self.entries.put(held)
        yield pd.DataFrame({"path": _texts([key[0]]), "n": [len(held)], "hashes": _texts([[h for h, _ in held]]), "last": [held[-1][1]]})

    def close(self) -> None:
        pass


def histories(events: DataFrame, most: int = 10, ttl: int | None = None) -> DataFrame:
    """``path, n, hashes, last``: of every file that changed, the hashes of its last
    ``most`` changes (``path, hash, at``), oldest first; forgotten after ``ttl`` ms. With a
    time to live Spark looks at the state again and again, so a run that is to stop by
    itself turns ``spark.sql.streaming.noDataMicroBatches.enabled`` off."""
    rows = events.where("path is not null and at is not null").select("path", "hash", "at")
    return rows.groupBy("path").transformWithStateInPandas(_History(most, ttl), "path string, n int, hashes array<string>, last timestamp", "Update", "ProcessingTime" if ttl else "None")


class _Bursts(StatefulProcessor):
    def __init__(self, stretch: float) -> None:
        self.stretch = stretch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getListState("waiting", "at long")

    def _flush(self, key, times: list[int], until: int) -> pd.DataFrame:  # noqa: ANN001
        """Bursts that end before the watermark; what is left waits for the next timer."""
        bursts = flushed(sorted(times), self.stretch)
        done = [b for b in bursts if b[2] <= until]
        rest = sorted(times)[sum(b[3] for b in done) :]
        self.waiting.put([(t,) for t in rest]) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer((bursts[len(done)][2] + 999) // 1000)
        return pd.DataFrame({"key": _texts([key[0]] * len(done)), "start": pd.to_datetime([b[0] for b in done], unit="us"), "last": pd.to_datetime([b[1] for b in done], unit="us"), "n": [b[3] for b in done]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        times = [t for (t,) in self.waiting.get()]
        for r in rows:
            times += r["us"].tolist()
        yield self._flush(key, times, 1000 * timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield self._flush(key, [t for (t,) in self.waiting.get()], 1000 * timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def dynamic_bursts(events: DataFrame, time: str, key: str, stretch: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """``key, start, last, n``: bursts of changes of a key, flushed after a time without a
    change that depends on how many wait (``GAPS``, in ms, times ``stretch``)."""
    rows = events.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, late).select(F.col(key).cast("string").alias("key"), F.col(time).alias("at"), F.unix_micros(F.col(time)).alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(_Bursts(stretch), "key string, start timestamp, last timestamp, n int", "Append", "EventTime")
