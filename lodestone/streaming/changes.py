"""Change streams: what the batch operators do, over Structured Streaming sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "path string, change string, hash string, at timestamp"
#: How late an event may come.
LATE = "10 minutes"


def read(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def bursts(events: DataFrame, time: str, keys: list[str], gap: str = "500 milliseconds", late: str = LATE) -> DataFrame:
    """Events of a key with less than ``gap`` between neighbours, once the burst is over."""
    own = events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return own.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def measured(events: DataFrame, time: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Number, mean and extremes by tumbling or sliding windows."""
    w = F.window(time, size, slide or size).alias("w")
    own = events.withWatermark(time, late).groupBy(*keys, w).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return own.select(*keys, F.col("w.start").alias("start"), "n", "mean", "least", "most")


def _judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ttl: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame(columns=["path", "change", "hash", "at"])
        return
    known = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["at", "kind"], kind="stable")
    gone, renamed = rows["kind"] == "delete", rows["kind"] == "rename"
    # what is stored after each event, and before it
    after = rows["hash"].where(~gone, None).astype(object)
    before = after.shift(1).astype(object)
    before.iloc[0] = known
    had, same = before.notna(), (before == after) & before.notna()
    change = np.select([renamed, gone & had, ~gone & ~same & had, ~gone & ~had], ["renamed", "deleted", "modified", "created"], "")
    last = after.iloc[-1]
    if last is None or pd.isna(last):
        state.remove() if state.exists else None
    else:
        state.update((last,))
        if ttl:
            state.setTimeoutDuration(ttl)
    some = change != ""
    yield pd.DataFrame({"path": key[0], "change": change[some], "hash": rows["hash"][some].to_numpy(), "at": rows["at"][some].to_numpy()})


def file_changes(events: DataFrame, ttl: int | None = None) -> DataFrame:
    """Raw events ``path, kind (add, change, delete, rename), hash, at`` to changes: created
    where no hash is stored, modified where another one is, deleted only where one is,
    renamed always; events that change nothing go. The state is one hash a file, which is
    forgotten ``ttl`` milliseconds after its last event; files spread over all tasks."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    return events.groupBy("path").applyInPandasWithState(lambda key, batches, state: _judge(key, batches, state, ttl), CHANGE, "hash string", "append", timeout)


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is available and stops; the checkpoint makes a rerun go on."""
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path).awaitTermination()


def run_each(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start().awaitTermination()


def into_table(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the last row of every key. Every batch writes a version of its own
    from the one before, and older ones go only then, so a batch that fails or is repeated
    leaves a whole table behind; ``table_at`` reads the newest."""
    from ..operators.changes import latest

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = [v for v in _versions(spark, path) if v < number]
        rows = batch.unionByName(spark.read.parquet(f"{path}/v{known[-1]}")) if known else batch
        latest(rows, keys, [F.desc(order)], 1).write.mode("overwrite").parquet(f"{path}/v{number}")
        for v in known[:-1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return each


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to their end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at)]
    whole = lambda n: system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and whole(n))


def table_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v{_versions(spark, path)[-1]}")
