"""Joins of lines with spans and with what stands near them, by blocks of lines.

Lines of a file are dealt out in blocks, so a long file is spread over tasks, and a line
meets only what reaches into its block: the spans around it, or two entities a line. Lines
that repeat are looked up once; their rows are joined to the answer by file and line, where
Spark may split a hot one. Cases: null files or lines match nothing and keep nulls; of
spans that begin on one line the shorter is the inner one, then the first by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a block.
BLOCK = 64
#: Lines between a relation and its ends, at most.
NEAR = 10


def _block(c: str, name: str = "_block"):  # noqa: ANN202
    return F.floor(F.col(c) / BLOCK).cast("int").alias(name)


def innermost(uses: DataFrame, spans: DataFrame, keys: tuple, prefix: str = "owner_") -> DataFrame:
    """``uses`` (``line``) with the innermost of ``spans`` (``start_line, end_line, name,
    kind``) around each line, as ``owner_line, owner_end, owner_name, owner_kind``."""
    lines = uses.select(*keys, "line").distinct().withColumn("_block", _block("line"))
    around = spans.select(*keys, "start_line", "end_line", "name", "kind", F.explode(F.sequence(_block("start_line"), _block("end_line"))).alias("_block"))
    found = lines.join(around, [*keys, "_block"]).where("line between start_line and end_line")
    best = found.groupBy(*keys, "line").agg(F.max_by(F.struct("start_line", "end_line", "name", "kind"), F.struct("start_line", -F.col("end_line"))).alias("s"))
    owners = best.select(*keys, "line", *[F.col(f"s.{c}").alias(f"{prefix}{n}") for c, n in (("start_line", "line"), ("end_line", "end"), ("name", "name"), ("kind", "kind"))])
    return uses.join(owners, [*keys, "line"], "left")


def endpoints(relations: DataFrame, entities: DataFrame, keys: tuple, near: int = NEAR) -> DataFrame:
    """``relations`` (``line``) with ``from_id`` and ``to_id``: the first two entities
    (``line, id``) of the file, by line and id, that begin at most ``near`` lines away;
    null where there are not two."""
    # no more than the first two of a line can be among the first two
    rank = F.row_number().over(Window.partitionBy(*keys, "line").orderBy("id"))
    few = entities.withColumn("_n", rank).where(F.col("_n") <= 2).select(*keys, F.col("line").alias("_at"), "id", F.floor(F.col("line") / (2 * near + 1)).cast("int").alias("_block"))
    lines = relations.select(*keys, "line").distinct()
    reach = lines.withColumn("_block", F.explode(F.array_distinct(F.array(*[F.floor((F.col("line") + d) / (2 * near + 1)).cast("int") for d in (-near, near)]))))
    found = reach.join(few, [*keys, "_block"]).where(F.abs(F.col("line") - F.col("_at")) <= near)
    first = F.slice(F.sort_array(F.collect_list(F.struct("_at", "id"))), 1, 2)  # of 4 near + 2 entities at most
    ends = found.groupBy(*keys, "line").agg(first.alias("e")).where(F.size("e") == 2).select(*keys, "line", F.col("e")[0]["id"].alias("from_id"), F.col("e")[1]["id"].alias("to_id"))
    return relations.join(ends, [*keys, "line"], "left")
