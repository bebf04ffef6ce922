"""Approximate nearest neighbours by shifted space-filling curves.

Every ordering projects the vectors onto a few random orthogonal directions, shifts the
cells by a random amount and walks them along a Hilbert curve. Spark range-partitions
the rows of all orderings by (ordering, key, id), so a task holds a stretch of a curve in
order, and a query looks at the ``window`` rows on either side of its own place in every
ordering. Rows there carry vectors rounded to one byte a component; what the windows
hold is merged, the nearest candidates by rounded distance are joined with the vectors
themselves and ranked by the exact distance.

A query sees 2 x ``ORDERINGS`` windows of rows, so with a fixed ``window`` work grows with
the table. Projections and scales are fitted on
``FIT_ROWS`` vectors (smallest hashes of their ids); all vectors are indexed. A window
ends at the edge of its task's stretch, of which other orderings have others; recall is
measured with these edges.

Equal vectors are indexed once, under their smallest id, with their k + 1 smallest ids
(the others could never be among the k nearest): so copies fill no window, a hot vector
costs as much as any other, and every query of equal vectors picks its neighbours from one
list by distance and id.

How wide a window has to be depends on the vectors, so it is measured: the true neighbours
of ``SAMPLE`` queries (by one scan) are looked for along the curves, and the window is as
wide as ``GOAL`` of them ask for, ``WINDOW`` at least. Clustered vectors keep it narrow,
vectors without any structure widen it as the table grows.

Cases: vectors that are null, zero or hold null or non-finite components take no part;
vectors of different lengths are no neighbours; equal distances go to the smaller id;
of rows that repeat an id the smallest vector counts; other columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .vectors import QUERY_EVERY, sizes_of, usable

ORDERINGS = 24
DIRECTIONS, BITS = 8, 6
#: Rows on either side of a query that it looks at in an ordering.
WINDOW = 700
#: Queries whose true neighbours are looked for, and the part of them to be found.
SAMPLE, GOAL = 64, 0.95
#: Rows of a range, on average.
RANGE_ROWS = 50_000
#: Nearest rows by rounded vectors that a window hands on, and that a query ranks exactly.
CANDIDATES = 40
FIT_ROWS = 10_000
SEED = 3


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of every row of cell numbers (by Gray-code steps
    from the highest bit down, all rows at once)."""
    axes = np.ascontiguousarray(cells.T.astype(np.int64))
    n = len(axes)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(n):
            high = (axes[i] >> level) & 1 == 1
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & below)
            axes[0] ^= np.where(high, below, swap)
            if i:
                axes[i] ^= swap
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    axes ^= turn
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((axes[i] >> level) & 1)
    return key


class Orderings:
    """Projection, scale and shift of every ordering, and how vectors are rounded."""

    def __init__(self, sample: np.ndarray, orderings: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        m = min(DIRECTIONS, d)
        self.parts = []
        for _ in range(orderings):
            turn = np.linalg.qr(rng.standard_normal((d, d)))[0][:, :m]
            y = sample @ turn
            self.parts.append((turn, y.mean(0), np.maximum(y.std(0), 1e-12), rng.random(m) / 8))
        self.centre = sample.mean(0)
        self.unit = max(float(np.quantile(np.abs(sample - self.centre), 0.999)) / 127, 1e-300)

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        """For every ordering the place of every row on its curve."""
        out = []
        for turn, centre, spread, shift in self.parts:
            place = np.clip(((x @ turn - centre) / spread + 3.5) / 7.0, 0.0, 1.0)
            out.append(hilbert_keys(np.minimum((place + shift) / 1.125 * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS))
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.centre) / self.unit), -127, 127).astype(np.int8)


def curves(rows: DataFrame, index: Orderings, d: int, total: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``o, key, id, code, asked``: rows (``vec_id, v, asked``) along all orderings, a
    stretch of a curve in order in each task."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                p = b.slice(at, 2000)
                x = p.column(1).flatten().to_numpy().reshape(-1, d)
                raw = index.codes(x).tobytes()
                codes = pa.array([raw[i * d : i * d + d] for i in range(len(x))], pa.binary())
                for o, key in enumerate(index.keys(x)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), o), pa.int32()), pa.array(key, pa.int64()), p.column(0), codes, p.column(2)], names=["o", "key", "id", "code", "asked"])

    spreaded = rows.select("vec_id", "v", "asked").mapInArrow(spread, "o int, key long, id long, code binary, asked boolean")
    ranges = max(1, ceil(total * len(index.parts) / range_rows))
    return spreaded.repartitionByRange(ranges, "o", "key", "id").sortWithinPartitions("o", "key", "id")


def window_candidates(dealt: DataFrame, d: int, window: int, candidates: int) -> DataFrame:
    """``query_id, vec_id, near``: from every window of every row that is ``asked`` for the
    nearest rows by rounded vectors."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        order, ids = t["o"].to_numpy(), t["id"].to_numpy()
        code = np.frombuffer(b"".join(t["code"].to_pylist()), np.int8).reshape(-1, d).astype(np.float32)
        length = (code * code).sum(1)
        for q in np.flatnonzero(t["asked"].to_numpy()).tolist():
            a, b = max(0, q - window), min(len(ids), q + window + 1)
            near = length[a:b] - 2.0 * (code[a:b] @ code[q])
            near[(order[a:b] != order[q]) | (ids[a:b] == ids[q])] = np.inf
            n = min(candidates, len(near))
            # of rows as near as the last one those of the smallest ids
            some = np.flatnonzero(near <= np.partition(near, n - 1)[n - 1])
            some = some[np.isfinite(near[some])]
            some = some[np.lexsort((ids[a:b][some], near[some]))[:n]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), ids[q])), pa.array(ids[a:b][some]), pa.array(near[some].astype(np.float64))], names=["query_id", "vec_id", "near"])

    return dealt.mapInArrow(look, "query_id long, vec_id long, near double")


def measured_window(held: DataFrame, dealt: DataFrame, d: int, k: int) -> int:
    """Rows on either side within which ``GOAL`` of the true neighbours of ``SAMPLE`` rows
    that are asked for stand in some ordering."""
    some = held.where("asked").orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE).select("vec_id", "v").collect()
    if not some:
        return WINDOW
    own, q = np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [(np.zeros(0), np.zeros(0, np.int64))] * len(own)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                ids = b.column(0).slice(at, 4096).to_numpy()
                x = b.column(1).slice(at, 4096).flatten().to_numpy().reshape(-1, d)
                far = (x * x).sum(1)[None, :] - 2 * (q @ x.T)
                far[own[:, None] == ids[None, :]] = np.inf
                for i in range(len(own)):
                    both = np.append(best[i][0], far[i]), np.append(best[i][1], ids)
                    first = np.argsort(both[0], kind="stable")[:k]
                    best[i] = both[0][first], both[1][first]
        for i, (far, ids) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), own[i])), pa.array(ids), pa.array(far)], names=["query_id", "vec_id", "far"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "vec_id"))
    true = held.select("vec_id", "v").mapInArrow(scan, "query_id long, vec_id long, far double").where("far < double('inf')").withColumn("n", rank).where(F.col("n") <= k)
    truth: dict[int, list[int]] = {}
    for r in true.collect():  # k rows of each sampled query
        truth.setdefault(r["query_id"], []).append(r["vec_id"])
    wanted = np.array(sorted({*truth, *(i for x in truth.values() for i in x)}), np.int64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_, at = [], 0
        for b in batches:
            ids = b.column(2).to_numpy()
            there = np.flatnonzero(np.isin(ids, wanted))
            held_ += zip(b.column(0).to_numpy()[there].tolist(), ids[there].tolist(), (at + there).tolist())
            at += len(ids)
        place = {(o, i): p for o, i, p in held_}
        rows_ = [(i, t, abs(place[o, t] - p)) for (o, i), p in place.items() if i in truth for t in truth[i] if (o, t) in place]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows_], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "apart"])

    found = dealt.mapInArrow(look, "query_id long, vec_id long, apart long").groupBy("query_id", "vec_id").agg(F.min("apart").alias("apart")).collect()
    apart = sorted(r["apart"] for r in found)
    most = sum(map(len, truth.values()))
    return max(WINDOW, apart[min(len(apart), ceil(GOAL * most)) - 1]) if apart else WINDOW


def groups_of(rows: DataFrame, k: int) -> DataFrame:
    """``vec_id, v, ids``: every vector once, with its k + 1 smallest ids, the smallest as
    its own. The limit holds in every task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("n", rank).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "v", "ids")


def nearest(vectors: DataFrame, k: int = 10, every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding", orderings: int = ORDERINGS, window: int | None = None, candidates: int = CANDIDATES, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score`` (Euclidean) for every id divisible by ``every``;
    without a ``window`` its width is measured."""
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    one = keep(usable(vectors, id_col, vector_col, zero_too=False).groupBy("vec_id").agg(F.min("v").alias("v")), "hilbert-vectors")
    for d, _ in sizes_of(one):  # hardly ever more than one length
        rows = one.where(F.size("v") == d)
        fit = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").collect()])
        index = Orderings(fit, orderings, seed)
        # queries with the id that their vector is indexed under
        lone = keep(groups_of(rows, k), "hilbert-groups")
        asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").join(lone.select("v", F.col("vec_id").alias("own")), "v").select("query_id", "own")
        asked = keep(asked, "hilbert-queries")
        held = lone.join(asked.select(F.col("own").alias("vec_id")).distinct().withColumn("asked", F.lit(True)), "vec_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        total = lone.count()
        wide = window or (measured_window(held, curves(held, index, d, total), d, k) if total > 2 * WINDOW else WINDOW)
        found = window_candidates(curves(held, index, d, total, max(RANGE_ROWS, 8 * wide)), d, wide, max(candidates, k))
        merged = found.groupBy("query_id", "vec_id").agg(F.min("near").alias("near"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "vec_id"))
        chosen = merged.withColumn("n", rank).where(F.col("n") <= max(candidates, k)).select("query_id", "vec_id")
        queries = held.where("asked").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("ids").alias("copies"))
        both = chosen.join(lone, "vec_id").join(queries, "query_id")
        squares = F.zip_with("v", "q", lambda a, b: (a - b) * (a - b))
        score = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))
        near = both.withColumn("score", score).select("query_id", F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id"))).alias("near"))
        # with the copies of the query's own vector: k + 1 ids of every candidate at most
        own = queries.select("query_id", F.transform("copies", lambda i: F.struct(F.lit(0.0).alias("score"), i.alias("vec_id"))).alias("near"))
        tops = near.unionByName(own).groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("top"))
        picked = asked.join(tops.withColumnRenamed("query_id", "own"), "own").select("query_id", F.posexplode(F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "x"))
        out = out.unionByName(picked.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score"))
    return out
