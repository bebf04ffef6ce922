"""Vector search over the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import vector as V
from .base import Catalog
from .texts import _jac, _kw

C = Catalog()
query = C.query
#: The query vector of the single searches: a function of the component's place only.
QUERY = [((i * 7) % 13 - 6) / 13 for i in range(64)]
SQL_QUERY = "(SELECT list_transform(range(64), lambda i: ((i * 7) % 13 - 6) / 13.0::DOUBLE))"
D = "embedding::DOUBLE[]"


def _top(expr: str, order: str, where: str = "true", k: int = 10) -> str:
    return f"SELECT vec_id, round({expr}, 6) AS score FROM embeddings WHERE {where} ORDER BY {expr} {order}, vec_id LIMIT {k}"


def _rounded(df):
    return df.select("vec_id", F.round("score", 6).alias("score"))


@query(_top(f"list_cosine_similarity({D}, {SQL_QUERY})", "DESC"))
def knn_cosine(t):
    return _rounded(V.search(t("embeddings"), QUERY))


@query(_top(f"list_inner_product({D}, {SQL_QUERY})", "DESC"))
def knn_dot(t):
    return _rounded(V.search(t("embeddings"), QUERY, measure="dot"))


@query(_top(f"list_distance({D}, {SQL_QUERY})", "ASC"))
def knn_euclid(t):
    return _rounded(V.search(t("embeddings"), QUERY, measure="euclid"))


@query(_top(f"list_sum(list_transform(list_zip({D}, {SQL_QUERY}), lambda z: abs(z[1] - z[2])))", "ASC"))
def knn_manhattan(t):
    return _rounded(V.search(t("embeddings"), QUERY, measure="manhattan"))


@query(_top(f"list_cosine_similarity({D}, {SQL_QUERY})", "DESC", "label IN (1, 3, 5)"))
def knn_filtered(t):
    return _rounded(V.search(t("embeddings"), QUERY, where=F.col("label").isin(1, 3, 5)))


@query(_top(f"list_cosine_similarity({D}, {SQL_QUERY})", "DESC", f"list_cosine_similarity({D}, {SQL_QUERY}) >= 0.1", 50))
def knn_threshold(t):
    return _rounded(V.search(t("embeddings"), QUERY, k=50, threshold=0.1))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.{D}, q.{D}) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def knn_batch(t):
    e = t("embeddings")
    found = V.batch_search(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), k=5)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(list_sum(list_transform({D}, lambda x: x * x)), 4) AS squared, 1.0::DOUBLE AS unit FROM embeddings")
def l2_normalize(t):
    e = F.col("embedding")
    unit = V.normalize(e)
    return t("embeddings").select("vec_id", F.round(V.dot(e, e), 4).alias("squared"), F.round(V.dot(unit, unit), 4).alias("unit"))


@query("SELECT count(*)::BIGINT AS n, avg(len(embedding)) AS size FROM embeddings")
def count_points(t):
    return t("embeddings").agg(F.count("*").alias("n"), F.avg(F.size("embedding")).alias("size"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 33, 333)")
def fetch_points(t):
    return t("embeddings").where(F.col("vec_id").isin(3, 33, 333)).select("vec_id", "label")


@query("SELECT count(*)::BIGINT AS valid FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64")
def validate_points(t):
    return t("embeddings").where(V.valid_point(F.col("vec_id"), F.col("embedding"), 64)).agg(F.count("*").alias("valid"))


def _embedded(key: str, table: str) -> str:
    words = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    slots = f"list_transform({words}, lambda w: ('0x' || substr(md5(w), 1, 4))::INT % 64)"
    return f"(SELECT {key} AS id, list_transform(range(64), lambda i: len(list_filter(s, lambda x: x = i))::DOUBLE) AS v FROM (SELECT {key}, {slots} AS s FROM {table}))"


@query(f"""WITH s AS (SELECT -1 - q.id AS query_id, d.id AS vec_id, round(CASE WHEN list_sum(q.v) > 0 AND list_sum(d.v) > 0 THEN list_cosine_similarity(d.v, q.v) ELSE 0.0 END, 6) AS score
FROM {_embedded('doc_id', 'documents')} d, {_embedded('item_id', 'benchmark')} q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT query_id, vec_id, rank, score FROM r WHERE rank <= 5""")
def search_by_text(t):
    embed = V.hashed_vectors
    of = lambda df, name, key: df.select(F.lit("text").alias("field"), key.alias(name), F.lit(None).cast("string").alias("tag"), F.lit(0).alias("part"), embed(F.coalesce("text", F.lit(""))).alias("v"))
    points, asked = of(t("documents"), "id", F.col("doc_id")), of(t("benchmark"), "query_id", -1 - F.col("item_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return V.block_search(points, asked, 5, -1.0).select("query_id", F.col("id").alias("vec_id"), rank.alias("rank"), "score")


ASKED = "the report of the nation and its trade by sea"


@query(f"""WITH q AS (SELECT 0 AS doc_id, '{ASKED}' AS text), e AS {_embedded('doc_id', 'documents')}, a AS {_embedded('doc_id', 'q')},
k AS (SELECT doc_id, {_kw('text')} AS w FROM documents), b AS (SELECT {_kw('text')} AS w FROM q),
s AS (SELECT k.doc_id, 0.7 * (CASE WHEN list_sum(e.v) > 0 THEN list_cosine_similarity(e.v, a.v) ELSE 0.0 END) + 0.3 * {_jac('k.w', 'b.w')} AS s FROM k JOIN e ON e.id = k.doc_id, a, b)
SELECT doc_id, round(s, 6) AS score FROM s ORDER BY round(s, 6) DESC, doc_id LIMIT 10""")
def hybrid_search(t):
    """Vector and keyword scores of documents for one text, by weight."""
    embed, asked = V.EMBEDDERS["hashed"], F.lit(ASKED)
    score = 0.7 * V.cosine(V.hashed_vectors(F.col("text")), embed(asked)) + 0.3 * T.jaccard(T.keywords(F.col("text")), T.keywords(asked))
    return t("documents").where("text is not null").select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)
