"""Micro-batches of changes as work that is done once, in order of priority.

A batch's changes are worked on kind by kind: deletions, then modifications, then
creations. Each kind that is done leaves a mark, so a batch that is repeated after a crash
goes on behind the last mark, and a batch with all its marks is skipped. Changes of a kind
that failed wait in a table, with the number of tries and the error, and come again with
the next batch; after the last try they go to a table of dead ones. Every table is written
once per batch id, so a repetition overwrites its own files only.

Cases: an empty batch only works on what waits; a null kind is of least priority; a handler
that fails after it wrote something is called again with the same rows, batch and kind, so
it should overwrite by them; repeated rows are handed on as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import priority

# fixed values: kinds by falling priority
ORDER = ["deleted", "modified", "created"]
TRIES = 3


def _path(spark: SparkSession, at: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, at: str) -> bool:
    path, system = _path(spark, at)
    return system.exists(path)


def _numbers(spark: SparkSession, at: str) -> list[int]:
    path, system = _path(spark, at)
    return sorted(int(n[1:]) for n in (s.getPath().getName() for s in system.listStatus(path)) if n[:1] == "b" and n[1:].isdigit()) if system.exists(path) else []


def prioritised(path: str, handler: Callable[[DataFrame, str, int], None], kind_col: str = "kind", order: list[str] | None = None, tries: int = TRIES) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``. ``handler`` gets the rows of one kind, the kind and the
    batch's number; what it raises makes that kind wait. Tables below ``path``: ``waiting``,
    ``dead``; marks: ``done``."""
    kinds = order or ORDER

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = lambda kind: f"{path}/done/{number}-{kind}"
        if _exists(spark, mark("all")):
            return
        known = [n for n in _numbers(spark, f"{path}/waiting") if n < number]
        rows = batch.withColumns({"tries": F.lit(0), "error": F.lit(None).cast("string")})
        if known:
            rows = rows.unionByName(spark.read.parquet(f"{path}/waiting/b{known[-1]}"))
        place = priority(F.col(kind_col), kinds)
        rows = rows.withColumn("_place", place)
        failed = f"{path}/failed/b{number}"
        for i, kind in [*enumerate(kinds, 1), (999, "other")]:
            if _exists(spark, mark(kind)):
                continue
            own = rows.where(F.col("_place") == i).drop("_place")
            error = None
            try:
                if not own.isEmpty():
                    handler(own.drop("tries", "error"), kind, number)
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"[:500]
            if error is not None:
                own.withColumns({"tries": F.col("tries") + 1, "error": F.lit(error)}).write.mode("overwrite").parquet(f"{failed}/{kind}")
            at, system = _path(spark, mark(kind))
            system.create(at, True).close()
        parts = [f"{failed}/{k}" for k in [*kinds, "other"] if _exists(spark, f"{failed}/{k}")]
        again = spark.read.parquet(*parts) if parts else rows.drop("_place").limit(0)
        again.where(F.col("tries") < tries).write.mode("overwrite").parquet(f"{path}/waiting/b{number}")
        if parts:
            again.where(F.col("tries") >= tries).write.mode("overwrite").parquet(f"{path}/dead/b{number}")
        at, system = _path(spark, mark("all"))
        system.create(at, True).close()

    return each


def waiting(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/waiting/b{_numbers(spark, f'{path}/waiting')[-1]}")


def dead(spark: SparkSession, path: str, schema: str) -> DataFrame:
    numbers = _numbers(spark, f"{path}/dead")
    return spark.read.parquet(*[f"{path}/dead/b{n}" for n in numbers]) if numbers else spark.createDataFrame([], schema)
