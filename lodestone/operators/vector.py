"""Vector measures and exact filtered search."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: Points of a shard of a search of blocks, on average.
SHARD_POINTS = 4096
#: Points and queries that meet in a tile of a batch search, on average, and the pairs of
#: a tile whose scores are held at once.
TILE_POINTS, TILE_QUERIES, HELD_PAIRS = 32_768, 8192, 1 << 22


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    parts = lambda s: F.struct((norm(s["a"]) * norm(s["b"])).alias("length"), dot(s["a"], s["b"]).alias("dot"))
    # what makes the vectors is worked out once, not wherever they are named
    return let(let(F.struct(a.alias("a"), b.alias("b")), parts), lambda s: F.when(s["length"] == 0, F.lit(0.0)).otherwise(s["dot"] / s["length"]))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


#: Measure and whether larger is nearer.
MEASURES = {"cosine": (cosine, True), "dot": (dot, True), "euclid": (euclid, False), "manhattan": (manhattan, False)}


def normalize(a: Column) -> Column:
    divided = lambda n: F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))
    return let(norm(a), divided)


def valid_point(vec_id: Column, vector: Column, size: int) -> Column:
    """An id, the right number of components, none of them null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec_id.isNotNull() & (vec_id.cast("string") != "") & (F.size(vector) == size) & finite


def search(points: DataFrame, query: list[float], k: int = 10, measure: str = "cosine", threshold: float | None = None, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of one query vector: one scan with the filter below the measure, and
    a top-k that keeps k rows a task."""
    f, larger = MEASURES[measure]
    df = points if where is None else points.where(where)
    df = df.withColumn("score", f(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])))
    if threshold is not None:
        df = df.where(F.col("score") >= threshold if larger else F.col("score") <= threshold)
    order = F.col("score").desc() if larger else F.col("score").asc()
    return df.orderBy(order, id_col).limit(k)


def _nearest(at: pd.DataFrame, of: pd.DataFrame, k: int, unit: bool, digits: int | None, cells: bool = False) -> pd.DataFrame:
    """``query_id, vec_id, score`` of the k points with the largest inner products with each
    query, ties to the smaller id. A product of matrices chooses, with a margin for its
    rounding; what it chooses is added up in the order of the places, so equal vectors tie.
    With ``cells`` a query (``cells``) meets the points of its cells (``cell``) alone."""
    out = [pd.DataFrame({"query_id": of["query_id"][:0], "vec_id": at["vec_id"][:0], "score": np.zeros(0)})]
    if len(at) and len(of):
        v, q = (np.vstack(x.to_numpy()).astype(np.float64) for x in (at["v"], of["q"]))
        added = lambda x: np.cumsum(x, axis=1)[:, -1]
        if unit:
            v, q = (x / np.where(n == 0, 1, n)[:, None] for x in (v, q) for n in [np.sqrt(added(x * x))])
        ids, asked = at["vec_id"].to_numpy(), of["query_id"].to_numpy()
        place = np.argsort(np.argsort(ids, kind="stable"))
        margin = 1e-9 * np.sqrt((v * v).sum(axis=1).max()) * np.sqrt((q * q).sum(axis=1)) + (0 if digits is None else 10.0**-digits)
        step = max(1, HELD_PAIRS // len(v))
        if cells:
            known, cell = np.unique(at["cell"].to_numpy(), return_inverse=True)
        for a in range(0, len(q), step):
            score = q[a : a + step] @ v.T
            score[asked[a : a + step, None] == ids] = -np.inf
            if cells:
                score[~np.vstack([np.isin(known, c) for c in of["cells"].iloc[a : a + step]])[:, cell]] = -np.inf
            least = np.partition(score, -k, axis=1)[:, -k] if k < len(v) else np.full(len(score), -np.inf)
            r, c = np.nonzero((score >= (least - margin[a : a + step])[:, None]) & (score > -np.inf))
            exact = np.concatenate([added(v[c[i : i + 65536]] * q[a + r[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0)])
            exact = exact if digits is None else np.round(exact, digits)
            order = np.lexsort((place[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append(pd.DataFrame({"query_id": asked[a + r[first]], "vec_id": ids[c[first]], "score": exact[first]}))
    return pd.concat(out)


def _finite(vector: str) -> Column:
    """Whether a vector has numbers alone."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0), F.lit(False))


def _every(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def _dealt(count: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")


def batch_search(points: DataFrame, queries: DataFrame, k: int = 10, measure: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of a stated set of queries (``query_id``,
    ``query``). Cosine and dot: tiles of points and queries meet as matrices, and k rows of
    a query leave a tile; other measures and vectors with entries that are no numbers are
    compared pair by pair. With ``digits`` scores are rounded before they are ranked, so
    that equal vectors tie."""
    f, larger = MEASURES[measure]
    at, asked = points.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), queries.select("query_id", F.col("query").alias("q"))
    n, m = at.count(), asked.count()

    def by_pairs(at: DataFrame, asked: DataFrame) -> DataFrame:
        shards = max(at.sparkSession.sparkContext.defaultParallelism, n // SHARD_POINTS)
        if measure == "cosine":  # lengths once a vector, not once a pair
            at, asked = at.withColumn("v", normalize(F.col("v"))), asked.withColumn("q", normalize(F.col("q")))
        score = (dot if measure == "cosine" else f)(F.col("v"), F.col("q"))
        met = at.withColumn("shard", _dealt(shards, "vec_id")).join(asked.withColumn("shard", _every(shards)), "shard")
        return met.where("vec_id <> query_id").select("query_id", "vec_id", (score if digits is None else F.round(score, digits)).alias("score"))

    if measure in ("cosine", "dot"):
        spread = at.sparkSession.sparkContext.defaultParallelism
        shards, blocks = max(min(spread, -(-n // 256)), -(-n // TILE_POINTS), 1), max(1, -(-m // TILE_QUERIES))
        kinds = dict(at.dtypes) | dict(asked.dtypes)
        left = at.where(_finite("v")).select("*", F.size("v").alias("size"), _dealt(shards, "vec_id").alias("shard"), _every(blocks).alias("block"))
        right = asked.where(_finite("q")).select("*", F.size("q").alias("size"), _dealt(blocks, "query_id").alias("block"), _every(shards).alias("shard"))
        tile = ["size", "shard", "block"]
        scored = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(lambda a, b: _nearest(a, b, k, measure == "cosine", digits), f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double")
        scored = scored.unionByName(by_pairs(at.where(~_finite("v")), asked)).unionByName(by_pairs(at.where(_finite("v")), asked.where(~_finite("q"))))
    else:
        scored = by_pairs(at, asked)
    order = F.col("score").desc() if larger else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Queries that meet a shard at once.
BLOCK_QUERIES = 2048


def block_search(points: DataFrame, queries: DataFrame, k: int, least: float, digits: int = 6) -> DataFrame:
    """``query_id, part, id, score``: of every (query_id, part) of ``queries`` (``field, v``
    and a ``tag`` or null) the k best points (``field, id, tag, v``) of the same field, and
    of the same tag where it has one, by cosine and then by id. Blocks of queries meet
    shards of points as matrices; scores are rounded before they are ranked, so equal
    vectors tie; k rows of a query leave a block. Vectors of length 0 are like nothing."""
    n, m = points.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_POINTS)), max(1, -(-m // BLOCK_QUERIES))
    every, own = _every, _dealt
    dealt = points.select("field", "id", "tag", normalize(F.col("v")).alias("v"), own(shards, "id").alias("shard"), every(blocks).alias("block"))
    asked = queries.select("field", "query_id", "part", F.col("tag").alias("want"), normalize(F.col("v")).alias("q"), own(blocks, "query_id", "part").alias("block"), every(shards).alias("shard"))
    keys = ["field", "shard", "block"]
    kinds = dict(queries.dtypes) | {"id": dict(points.dtypes)["id"]}

    def nearest(at: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        found = {c: [] for c in ("query_id", "part", "id", "score")}
        if len(at) and len(of):
            score = np.round(np.vstack(of["q"].to_numpy()) @ np.vstack(at["v"].to_numpy()).T, digits)
            ids, tags = (np.array(at[c].tolist(), object) for c in ("id", "tag"))
            order = {x: i for i, x in enumerate(sorted(set(ids)))}
            place = np.array([order[x] for x in ids])
            for i, (query, part, want) in enumerate(zip(of["query_id"].tolist(), of["part"].tolist(), of["want"].tolist())):
                some = np.flatnonzero((score[i] >= least) & ((tags == want) if isinstance(want, str) else True))
                some = some[np.lexsort((place[some], -score[i, some]))[:k]]
                for c, values in zip(found, ([query] * len(some), [part] * len(some), ids[some].tolist(), score[i, some].tolist())):
                    found[c] += values
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in found.items()})

    found = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(nearest, f"query_id {kinds['query_id']}, part int, id {kinds['id']}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """The offline embedder: words counted in hashed slots, of length 1.

    Each word puts the letter of its slot (at most 128) in a string; how much shorter that
    is without a letter is its count. So words are looked at once, not once a slot."""
    if not 0 < size <= 128:
        raise ValueError("an embedding has 1 to 128 slots")
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    letters = F.array_join(F.transform(words, lambda w: F.chr(F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % size)), "")
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.length(own) - F.length(F.replace(own, F.chr(i)))).cast("double"))
    return let(let(letters, counts), normalize)


#: Slots of words that a worker remembers.
REMEMBERED = 1 << 17


@functools.lru_cache(REMEMBERED)
def _slot(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16)


def hashed_vectors(text: Column, size: int = 64) -> Column:
    """``hashed_embedding`` of whole columns as an Arrow UDF: the same vectors, but words
    are counted without an expression for each. It cannot stand within a lambda."""

    @F.arrow_udf("array<double>")
    def counted(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), size))
        for row, t in zip(out, texts.to_pylist()):
            slots = np.fromiter(map(_slot, (t or "").split()), np.int64)
            row += np.bincount(slots % size, minlength=size)
        length = np.sqrt((out * out).sum(axis=1))  # of whole numbers, so exact in any order
        out /= np.where(length == 0, 1, length)[:, None]
        ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * size)
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.when(text.isNotNull(), counted(words))


#: Embedders by name; ``register`` adds one.
EMBEDDERS = {"hashed": hashed_embedding}


def register(name: str, embedder) -> None:  # noqa: ANN001
    EMBEDDERS[name] = embedder


#: Share of the cells that a query of the approximate search looks into.
PROBED = 0.75
CELLS_MOST = 1024


def approximate_search(points: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probed: float = PROBED, seed: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` by cosine, approximately: unit vectors belong to
    the cell of the nearest of some chosen vectors (the square root of their number,
    ``CELLS_MOST`` at most), a query looks into the nearest ``probed`` share of the cells,
    and what is there is ranked exactly. Points are dealt by cell once. Vectors of length
    0 take no part. Without any structure among the vectors (2,000 of them) a recall of
    0.92 asks for 0.7 of the cells; clustered ones need far fewer."""
    unit = lambda df, key, vector, name: df.where(norm(F.col(vector)) > 0).select(F.col(key).alias(name), normalize(F.col(vector)).alias("v"))
    at, asked = unit(points, id_col, vector_col, "vec_id"), unit(queries, "query_id", "query", "query_id")
    cells = min(CELLS_MOST, max(1, int(at.count() ** 0.5)))
    chosen = [r["v"] for r in at.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(cells).collect()]
    centres = np.array(chosen).T if chosen else np.zeros((1, 1))

    def nearest_cells(n: int):  # noqa: ANN202
        @F.pandas_udf("array<int>")
        def f(v: pd.Series) -> pd.Series:
            score = np.vstack(v.to_numpy()) @ centres if len(v) else np.zeros((0, n))
            return pd.Series(list(np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)), dtype=object)

        return f

    # a tile holds some of the cells, so a query goes to a tile once, however many it probes
    n, m = at.count(), asked.count()
    shards, blocks = max(1, min(len(chosen), max(at.sparkSession.sparkContext.defaultParallelism, -(-n // TILE_POINTS)))), max(1, -(-m // TILE_QUERIES))
    dealt = at.withColumn("cell", nearest_cells(1)("v")[0]).withColumns({"shard": F.pmod("cell", F.lit(shards)), "block": _every(blocks)})
    probes = asked.select("query_id", F.col("v").alias("q"), _dealt(blocks, "query_id").alias("block"), nearest_cells(max(1, round(probed * max(1, len(chosen)))))("v").alias("all"))
    probes = probes.withColumn("shard", _every(shards)).withColumn("cells", F.filter("all", lambda c: F.pmod(c, F.lit(shards)) == F.col("shard"))).where(F.size("cells") > 0).drop("all")
    kinds = dict(at.dtypes) | dict(asked.dtypes)
    scored = dealt.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block")).applyInPandas(lambda a, b: _nearest(a, b, k, False, None, cells=True), f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
