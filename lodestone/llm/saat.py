"""Exact top-k search by an impact-ordered, score-at-a-time index.

Vectors are made integers. A shard of the index holds, for every bit of the component
sizes, one posting segment: which vectors have that bit in which dimension, with the
sign. The impact of all its postings is the bit's value, so going from the highest bit
down processes postings by descending quantised impact and accumulates scores. After
each segment what is left of a vector is known by its length, so the true score lies
within |query| x |rest| of the accumulated one (Cauchy and Schwarz). A query stops only
once these bounds prove that few vectors can be members; those are scored exactly.

Every point goes to one shard, whose index is built once, in the task that has it; blocks
of queries stream past it, so only the stated queries are copied to all shards. Every
block gives its k best of a shard, of which each query's k best are kept.

Cases: null vectors and null or non-finite components take no part; a zero vector does;
vectors of different lengths have no product; of rows that repeat an id the smallest
vector counts; equal scores go to the smaller id; other columns are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .vectors import QUERY_EVERY, best, sizes_of, usable

SCALE = 1024
SHARD_ROWS = 16384
QUERY_BLOCK = 512
#: A query stops when at most this share of a shard (and k) can still be members.
FEW = 0.02


class Shard:
    """Posting segments of one shard, by descending impact."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        size, sign = np.abs(x), np.sign(x).astype(np.float32)
        self.segments = []  # impact, postings (vectors x dimensions), length of the rest
        for bit in range(int(size.max(initial=0)).bit_length() - 1, -1, -1):
            rest = (size & ((1 << bit) - 1)).astype(np.float64)
            self.segments.append((float(1 << bit), (size >> bit & 1) * sign, np.sqrt((rest * rest).sum(1))))

    def top(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (places, scores) of its k best, those of its own id left out."""
        out: list = [None] * len(q)
        kind = np.float32 if np.abs(q).max(initial=0) * q.shape[1] < 1 << 24 else np.float64
        length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        score = np.zeros((len(q), len(ids)))
        score[own[:, None] == ids[None, :]] = -np.inf
        active = np.arange(len(q))
        few = max(4 * k, int(FEW * len(ids)))
        for s, (impact, postings, rest) in enumerate([*self.segments, (0.0, None, np.zeros(len(ids)))]):
            if postings is not None:
                score[active] += impact * (q[active].astype(kind) @ postings.astype(kind).T)
            last = s >= len(self.segments) - 1
            going = []
            for a in active:
                bound = length[a] * rest
                low = score[a] - bound
                edge = np.partition(low, -min(k, len(low)))[-min(k, len(low))]
                # one more unit for rounding in the bound
                members = np.flatnonzero((score[a] + bound + 1 >= edge - 1) & (score[a] > -np.inf))
                if len(members) > few and not last:
                    going.append(a)
                    continue
                exact = self.x[members] @ q[a]
                best_ = np.lexsort((ids[members], -exact))[:k]
                out[a] = members[best_], exact[best_]
            active = np.array(going, dtype=np.int64)
            if not len(active):
                break
        return out


def top_inner(vectors: DataFrame, k: int = 10, every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of every
    query (ids divisible by ``every``) among all other vectors."""
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")
    rows = keep(usable(vectors, id_col, vector_col, zero_too=True).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", whole), "saat-vectors")
    for d, total in sizes_of(rows):  # hardly ever more than one length
        out = out.unionByName(best(_shard_tops(rows.where(F.size("v") == d), d, max(1, ceil(total / shard_rows)), k, every), k, ascending=False))
    return out


def _shard_tops(rows: DataFrame, d: int, shards: int, k: int, every: int) -> DataFrame:
    """``query_id, vec_id, score``: of every shard the k best of every query."""
    # the points of a shard come first (no query), then all queries
    points = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("s"), F.lit(False).alias("query"), "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.lit(True).alias("query"), "vec_id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, points, index = -1, [], [], None
        for b in batches:
            kinds = b.column(0).to_numpy() * 2 + b.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), b.num_rows]
            for first, last in zip(edges[:-1], edges[1:]):
                if first == last:
                    continue
                shard, query = divmod(int(kinds[first]), 2)
                own = b.column(2).to_numpy()[first:last]
                x = b.column(3).slice(first, last - first).flatten().to_numpy().reshape(-1, d)
                if shard != at:
                    at, ids, points, index = shard, [], [], None
                if not query:
                    ids.append(own)
                    points.append(x)
                    continue
                if index is None and ids:
                    ids, points = np.concatenate(ids), np.concatenate(points)
                    index = Shard(points)
                if index is None:
                    continue
                for n in range(0, len(x), QUERY_BLOCK):
                    for i, (where, score) in zip(own[n : n + QUERY_BLOCK], index.top(x[n : n + QUERY_BLOCK], own[n : n + QUERY_BLOCK], ids, k)):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), i)), pa.array(ids[where]), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])

    dealt = points.unionByName(queries).repartition(shards, "s").sortWithinPartitions("s", "query", "vec_id")
    return dealt.mapInArrow(search, "query_id long, vec_id long, score long")
