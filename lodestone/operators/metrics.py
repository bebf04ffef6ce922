"""Operational metrics over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(events: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, least, most and exact percentiles: the value at floor(n p) in order.
    Ranks come from a window, so no group is gathered into one value."""
    w = Window.partitionBy(key)
    ranked = events.select(key, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("i") == F.floor(F.col("n") * p), F.col(value)))
    return ranked.groupBy(key).agg(F.max("n").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def counts_of_all(events: DataFrame, key: str, values: list[str], k: int = 10) -> DataFrame:
    """How often each of the stated values occurs, zeros included, most frequent first."""
    named = events.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    counted = events.groupBy(key).agg(F.count("*").alias("n"))
    return named.join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def recent(events: DataFrame, time: str, key: str, value: str, span: str, failed: Column) -> DataFrame:
    """Operations a second, mean and share of failures in the last ``span``."""
    last = events.agg(F.max(time).alias("now"))
    df = events.join(F.broadcast(last)).where(F.col(time) > F.col("now") - F.expr(f"interval {span}"))  # a single row
    return df.groupBy(key).agg((F.count("*") / 60.0).alias("per_second"), F.round(F.avg(value), 4).alias("mean"), F.round(F.avg(failed.cast("double")), 6).alias("share"))


def trend(events: DataFrame, key: str, value: str, order: list[str], edge: float = 0.1) -> DataFrame:
    """Relative change from the first to the last value and its direction."""
    ends = events.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("a"), F.max_by(value, F.struct(*order)).alias("b"))
    change = F.when(F.col("a") == 0, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.col("a"))
    return ends.select(key, F.round(change, 6).alias("change"), F.when(change > edge, "increasing").when(change < -edge, "decreasing").otherwise("stable").alias("trend"))


def history(events: DataFrame, time: str, key: str, value: str, bucket: str) -> DataFrame:
    df = events.groupBy(key, F.window(time, bucket).alias("w"))
    return df.agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.sum(value), 4).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(key, F.col("w.start").alias("start"), "n", "mean", "total", "least", "most")


def severity(value: Column, threshold: float, factors: tuple[float, float]) -> Column:
    """medium above the threshold, high and critical above its multiples; else null."""
    return F.when(value > threshold * factors[1], "critical").when(value > threshold * factors[0], "high").when(value > threshold, "medium")


def low_streaks(events: DataFrame, time: str, value: str, threshold: float, readings: int, keys: list[str]) -> DataFrame:
    """Readings that end a run of ``readings`` values below the threshold."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(1 - readings, 0)
    low = F.sum((F.col(value) < threshold).cast("int")).over(w)
    return events.withColumn("low", low).where(F.col("low") == readings).withColumn("severity", F.when(F.col(value) < 0.5 * threshold, "critical").when(F.col(value) < 0.75 * threshold, "high").otherwise("medium"))


def error_log(errors: DataFrame, level: str | None = None, category: str | None = None, tags: list[str] | None = None, resolved: bool | None = None, since: object = None, until: object = None) -> DataFrame:
    """Errors (``id, level, category, tags, resolved, at``) that meet all that is asked for,
    newest first, then by id: any of some tags, times with both ends. What is null meets
    nothing that is asked of it."""
    tests = [
        None if level is None else F.col("level") == level,
        None if category is None else F.col("category") == category,
        F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])) if tags else None,
        None if resolved is None else F.col("resolved") == resolved,
        None if since is None else F.col("at") >= since,
        None if until is None else F.col("at") <= until,
    ]
    for test in tests:
        errors = errors if test is None else errors.where(test)
    return errors.orderBy(F.desc("at"), "id")
