"""A query is a Spark function with, where SQL can express it, SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Registers a function of a table reader under its name."""

        def add(f: Callable) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
