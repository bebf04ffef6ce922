"""What both vector searches share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_EVERY = 100


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero_too: bool) -> DataFrame:
    """``vec_id, v array<double>`` without the rows that take no part: null vectors, null
    or non-finite components, a null id and, unless ``zero_too``, zero vectors."""
    v = F.col(vector_col).cast("array<double>")
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    inf = float("inf")
    df = df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf)))
    return df if zero_too else df.where(F.exists("v", lambda x: x != 0.0))


def sizes_of(df: DataFrame) -> list[tuple[int, int]]:
    """Every number of components with how many vectors have it: as many rows as there are
    lengths. Vectors are compared with those of their own length."""
    return [(r["n"], r["count"]) for r in df.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]


def best(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """Ranks of the k best of each query; equal scores go to the smaller id. The rank
    limit holds before the shuffle too, so no task gets more than k rows of each."""
    score = F.col("score").asc() if ascending else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
