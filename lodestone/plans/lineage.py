"""Cutting the lineage of iterative jobs where all executors reach the result."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, where driver and executors reach it. Only on
    one machine, as in tests, a temporary one is set where none is named."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
