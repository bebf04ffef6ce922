"""Mixing sources to target weights by Sainte-Lague apportionment.

The target of a source is an amount of words. Blocks of equal size are the seats: they
are given to sources by highest quotients (votes / 1, 3, 5, ...), then in the same way
to teams of shards of each source and to the shards of each team. Inside a shard the documents stand in a seeded order, so
the shard's blocks are numbered along that order and the quota takes whole rounds of
the shard first and then its first blocks; a block may end inside a document.

Cases: a null text has size 0; a null source is a source of its own, ordered last;
repeated rows and rows that repeat an id or have none are rows of their own, as nothing
joins on ids (equal rows get their shares in any order); an empty table gives an empty table; with no words
at all every target is 0; columns of the input with other names are kept apart (only
the three named ones are read).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep

#: Words of a block: the unit that is apportioned.
BLOCK_WORDS = 16
#: Words that a shard holds on average; a source gets as many shards as its size asks for.
SHARD_WORDS = 200_000
#: Shards whose quotas are made together.
TEAM_SHARDS = 4096


def water_fill(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets: ``share`` x the sum of sizes dealt by weight; what exceeds ``cap`` x a
    size is dealt anew by weight among the rest until no target is above."""
    total = share * sum(sizes)
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        rest = total - sum(out)
        by = sum(weights[i] for i in open_)
        above = [i for i in open_ if rest * weights[i] / by > cap * sizes[i]]
        if not above:
            for i in open_:
                out[i] = rest * weights[i] / by
            break
        for i in above:
            out[i] = float(cap * sizes[i])
        open_ = [i for i in open_ if i not in set(above)]
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1); ties go to the earlier entry.

    The quotient of the last seat lies near sum(votes) / (2 seats): all seats above a
    slightly higher quotient are given at once, the few left one at a time.
    """
    votes = np.asarray(votes, dtype=np.float64)
    got = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return got
    low = votes.sum() / (2.0 * seats + 2 * len(votes) + 2)
    high = votes.max() + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        n = np.floor((votes / mid + 1) / 2).sum()
        low, high = (mid, high) if n > seats else (low, mid)
    got = np.floor((votes / high + 1) / 2).astype(np.int64)
    while (left := int(seats - got.sum())) > 0:  # once, but for rounding: these quotients are equal
        got[np.argsort(-(votes / (2 * got + 1)), kind="stable")[:left]] += 1
    return got


def source_targets(totals: list[tuple], weights: tuple, share: float, cap: float, block: int) -> list[tuple]:
    """(source, size) of every source to (number, source, size, target, blocks, words of a block)."""
    order = sorted(totals, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r[1] or 0) for r in order]
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(order))], share, cap)
    # a small corpus has smaller blocks, so that every source gets some thousand of them
    block = int(min(block, max(1, sum(target) // (1000 * max(1, len(order))))))
    seats = sainte_lague(np.array(target), round(sum(target) / block)) if order else []
    return [(i, r[0], s, float(t), int(n), block) for i, (r, s, t, n) in enumerate(zip(order, sizes, target, seats))]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 7,
    with_row: bool = False,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, the shard and the seeded rank of every document;
    ``with_row`` adds the document's own columns as the struct ``row``.

    The per-source totals (one row a source: the table that mixing weights are set for)
    come to the driver; everything per document or shard stays distributed. Shards hold
    about ``shard_words`` words however large a source is, so no window grows with it.
    """
    spark = docs.sparkSession
    # texts take part in the order, so that rows without ids are dealt over the shards
    read = [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark")]
    sizes = keep(docs.select(*read), "mix-sizes")
    totals = [(r[0], r[1]) for r in sizes.groupBy("source").agg(F.sum("size")).collect()]
    targets = source_targets(totals, weights, share, cap, block)
    of_source = spark.createDataFrame(targets, "source_no int, source string, source_size long, target double, blocks long, block int").withColumn("shards", F.ceil(F.greatest(F.col("source_size") / shard_words, F.lit(1.0))).cast("long"))

    def place(rows: DataFrame) -> DataFrame:
        # a row a source, as at the driver already
        named = rows.join(F.broadcast(of_source.withColumnRenamed("source", "named")), F.col("source").eqNullSafe(F.col("named")))
        keyed = named.withColumn("rank_key", F.xxhash64(F.col("doc_id"), F.col("mark"), F.lit(seed)))
        return keyed.withColumn("shard", F.pmod(F.xxhash64(F.col("rank_key"), F.lit("shard")), F.col("shards")))

    def seats(entry: str, votes: str):  # noqa: ANN202
        return lambda pdf: pdf.sort_values(entry).assign(seats=lambda x: sainte_lague(x[votes].to_numpy(), int(x["blocks"].iloc[0])))[[c for c in ("source_no", "team", "shard", "shard_size", "seats") if c in pdf.columns or c == "seats"]]

    # from sources to teams of shards, then to the shards of each team: no group grows with
    # its source (a team of TEAM_SHARDS; a source of 10^12 words has some thousand teams)
    shards = place(sizes).groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"), F.first("block").alias("block"))
    shards = shards.withColumn("team", F.floor(F.col("shard") / TEAM_SHARDS))
    teams = shards.groupBy("source_no", "team").agg(F.sum("shard_size").alias("team_size"), F.first("blocks").alias("blocks"))
    given = teams.groupBy("source_no").applyInPandas(seats("team", "team_size"), "source_no int, team long, seats long").withColumnRenamed("seats", "blocks")
    quota = shards.drop("blocks").join(given, ["source_no", "team"]).groupBy("source_no", "team").applyInPandas(seats("shard", "shard_size"), "source_no int, team long, shard long, shard_size long, seats long")
    quota = quota.select("source_no", "shard", "shard_size", F.col("seats").alias("quota"))
    order = Window.partitionBy("source_no", "shard").orderBy("rank_key", "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, 0)
    allowed = F.least(F.col("quota") * F.col("block"), (F.col("shard_size") * cap).cast("long"))
    rounds = F.when(F.col("shard_size") > 0, F.floor(allowed / F.col("shard_size"))).otherwise(0)
    rest = allowed - rounds * F.col("shard_size")
    begin = F.col("upto") - F.col("size")
    placed = place(docs.select(*read, F.struct(*docs.columns).alias("row")) if with_row else sizes)
    return (
        placed.withColumn("upto", F.sum("size").over(order))
        .join(quota, ["source_no", "shard"])  # after the window, so rows are dealt once
        .select(
            "doc_id", "size", "source_size", "target",
            (rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("upto"), rest) - begin)).cast("long").alias("taken"),
            "source", "shard", "rank_key", *(["row"] if with_row else []),
        )
    )


def first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    """The shortest prefix of each text that holds its first ``n`` words."""
    import re

    word = re.compile(WORD)
    out = []
    for t, k in zip(text, n):
        end = 0
        for i, m in enumerate(word.finditer(t or "")):
            if i >= k:
                break
            end = m.end()
        out.append((t or "")[:end])
    return pd.Series(out)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is
    taken whole, and its first words where a block ends inside it. Documents of no words
    or that no block covers go. Every row is carried to its share, so ids may be null or
    repeated."""
    taken = mix_sources(docs, with_row=True, **options).where("taken > 0").select("row", "size", "taken")
    often = F.expr("concat(array_repeat(size, int(taken div size)), if(taken % size > 0, array(taken % size), cast(array() as array<bigint>)))")
    parts = taken.select("row", "size", F.explode(often).alias("n"))
    ends = F.col("n") < F.col("size")
    # only texts that are cut go to Python
    parts = parts.withColumn("cut", F.pandas_udf(first_words, "string")(F.when(ends, F.col("row.text")), F.col("n")))
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return parts.select(*[F.when(ends, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
