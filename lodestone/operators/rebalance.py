"""Chunks of like size: what is too large is cut at a size taken from the document's own
chunks, what is too small joins the chunk before it where both go together.

Cutting is a fold over a chunk's lines, joining one over the sizes and types of a
document's chunks (not their texts), both linear. Cases: null types and languages are
alike; a line longer than the target is cut by characters only if it is a chunk of its
own; the first chunk joins nothing; blank chunks join like others; an empty table stays so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, scan
from .chunking import _fold, _one, lines_of

LEAST, MOST = 100, 1000
# fixed values: types that stay alone, marks of definitions, types that go together, and
# the part of the mean size that is aimed at
ALONE = ["function", "class", "method", "interface"]
MARKS = ["function ", "class ", "=>"]
TOGETHER = [["semantic", "function", "class", "method"], ["code", "import", "variable"]]
AIM = 0.8


def target_sizes(rows: DataFrame, keys: tuple, least: int, most: int) -> DataFrame:
    """``keys, target``: four fifths of a document's mean chunk, within the limits."""
    return rows.groupBy(*keys).agg(F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), AIM * F.avg(F.length("content")))).alias("target"))


def line_pieces(content: Column, target: Column) -> Column:
    """Numbers of the lines that end a piece: as many lines as fit, one at least."""
    def step(s: Column, x: Column, last: Column):  # noqa: ANN202
        over = (s["size"] + x["len"] + 1 > target) & (s["size"] > 0)
        return _one(over, x["i"] - 1), {"size": F.when(over, 0).otherwise(s["size"]) + x["len"] + 1}

    return _fold(lines_of(content), lambda x: {}, {"size": F.lit(0)}, step)


def split_large(rows: DataFrame, keys: tuple, least: int, most: int) -> DataFrame:
    """Chunks as pieces: ``piece`` counts them, ``whole`` is whether it was left as it was."""
    held = rows.join(target_sizes(rows, keys, least, most), list(keys))
    kind = "array<struct<b:int,e:int,content:string>>"

    def by_lines(lines: Column) -> Column:
        ends = line_pieces(F.col("content"), F.col("target"))
        spans = let(ends, lambda at: F.transform(at, lambda e, i: F.struct(F.coalesce(F.get(at, i - 1) + 1, F.lit(0)).alias("b"), e.alias("e"))))
        return F.transform(spans, lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), F.array_join(F.slice(lines, s["b"] + 1, s["e"] - s["b"] + 1), "\n").alias("content"))).cast(kind)

    size = F.floor("target").cast("int")
    by_chars = F.transform(F.sequence(F.lit(0), F.length("content") - 1, size), lambda b: F.struct(F.lit(0).alias("b"), F.lit(0).alias("e"), F.substring("content", b + 1, size).alias("content"))).cast(kind)
    same = F.array(F.struct(F.lit(0).alias("b"), (F.col("end_line") - F.col("start_line")).alias("e"), F.col("content").alias("content"))).cast(kind)
    large = F.length("content") > most
    pieces = F.when(~large, same).otherwise(let(lines_of(F.col("content")), lambda lines: F.when(F.size(lines) > 1, by_lines(lines)).otherwise(by_chars)))
    cut = held.withColumn("whole", ~large).select(*keys, "chunk", "start_line", "type", "language", "whole", F.posexplode(pieces).alias("piece", "p"))
    return cut.select(*keys, "chunk", "piece", (F.col("start_line") + F.col("p.b")).alias("start_line"), (F.col("start_line") + F.col("p.e")).alias("end_line"), "p.content", "type", "language", "whole")


def rebalance(rows: DataFrame, least: int = LEAST, most: int = MOST, keys: tuple = ("doc_id",)) -> DataFrame:
    """Chunks (``chunk, start_line, end_line, content, type, language``) anew, numbered in
    order."""
    pieces = split_large(rows, keys, least, most)
    fits = lambda a, b: a.eqNullSafe(b) | _any([a.isin(group) & b.isin(group) for group in TOGETHER])
    small = F.col("whole") & (F.length("content") < least) & ~F.coalesce(F.col("type").isin(ALONE), F.lit(False)) & ~_any([F.col("content").contains(m) for m in MARKS])
    item = F.struct("chunk", "piece", F.length("content").alias("size"), "type", "language", small.alias("small"))
    held = pieces.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_c"))
    state = "struct<size:int,type:string,language:string,into:int,next:int>"

    def step(s: Column, x: Column) -> Column:
        joins = (s["into"] >= 0) & x["small"] & (s["size"] + x["size"] <= most) & F.coalesce(fits(s["type"], x["type"]), F.lit(False)) & s["language"].eqNullSafe(x["language"])
        new = F.struct(x["size"].alias("size"), x["type"].alias("type"), x["language"].alias("language"), s["next"].alias("into"), (s["next"] + 1).alias("next"))
        grown = F.struct((s["size"] + 1 + x["size"]).alias("size"), s["type"].alias("type"), s["language"].alias("language"), s["into"].alias("into"), s["next"].alias("next"))
        return F.when(joins, grown.cast(state)).otherwise(new.cast(state))

    begin = F.struct(F.lit(0).alias("size"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("language"), F.lit(-1).alias("into"), F.lit(0).alias("next")).cast(state)
    into = scan(F.col("_c"), begin, step, lambda s: s["into"], "int")
    groups = held.select(*keys, F.explode(F.arrays_zip(F.transform("_c", lambda c: F.struct(c["chunk"], c["piece"])).alias("at"), into.alias("into"))).alias("g"))
    groups = groups.select(*keys, F.col("g.at.chunk").alias("chunk"), F.col("g.at.piece").alias("piece"), F.col("g.into").alias("into"))
    part = F.sort_array(F.collect_list(F.struct("chunk", "piece", "start_line", "end_line", "content", "type", "language")))
    joined = pieces.join(groups, [*keys, "chunk", "piece"]).groupBy(*keys, "into").agg(part.alias("p"))
    first, last = F.col("p")[0], F.element_at("p", -1)
    return joined.select(*keys, F.col("into").alias("chunk"), first["start_line"].alias("start_line"), last["end_line"].alias("end_line"), F.array_join("p.content", "\n").alias("content"), first["type"].alias("type"), first["language"].alias("language"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
