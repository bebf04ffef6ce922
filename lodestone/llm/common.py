"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of ``documents``: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only on one machine, as in tests, a
    temporary folder is made and set for the session where that is unset.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table written by ``keep`` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame, name: str = "table", path: str | None = None, by: str | None = None, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, and an
    executor that is lost later costs no recomputation. ``by`` gives each value of a
    column a folder of its own."""
    path = path or new_path(df.sparkSession, name)
    writer = df.write.options(**options)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns to the system what a worker has freed. Workers serve one task after another,
    and the allocators of C and Arrow keep the most that any of them needed."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # of glibc
        libc.malloc_trim(0)


#: Seconds between two times that a running task gives memory back.
GIVE_BACK_S = 1.0


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of ``mapInArrow``, giving memory back as it goes and at its end."""

    def leanly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for p in run(batches):
            yield p
            del p
            if time.monotonic() - last > GIVE_BACK_S:
                give_back()
                last = time.monotonic()
        give_back()

    return leanly


def lean_group(f: Callable) -> Callable:
    """``f`` of ``applyInPandas`` for one group, giving memory back behind it."""

    def leanly(pdf):  # noqa: ANN001, ANN202
        try:
            return f(pdf)
        finally:
            give_back()

    return leanly


#: Bytes of text that a worker takes at once; a longer text goes alone.
BATCH_BYTES = 1 << 22


def batched(batches: Iterator[pa.RecordBatch], most: int, column: int, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together anew: up to ``most`` rows and ``most_bytes`` of the
    values of one column, but one row at least."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(total[at - 1]) if at else 0
            fits = int(np.searchsorted(total, before + most_bytes - size, side="right"))
            end = min(b.num_rows, at + most - rows, max(fits, at + (not held)))
            if end > at:
                held.append(b.slice(at, end - at))
                rows, size = rows + end - at, size + int(total[end - 1]) - before
            if end < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, size = [], 0, 0
            at = end
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would change other letters too)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
