"""Searching files by three vectors: what a query is about decides which of the vectors of
name, path and description it meets, and with what weight; results are put together by
path, filtered and ordered. Also suggestions for what was typed.

Cases: a null or blank query finds nothing; files without a path are not indexed; a null
description is empty, and an empty vector is like nothing; a file found by several parts of
a query counts with the first of them; equal scores go to the newer file (unknown times
last), then by path; repeated paths of files count once, the last by description.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let
from .vector import block_search

# fixed values: what is suggested, in this order
EXTENSIONS = ".js .ts .jsx .tsx .py .java .cpp .c .h .html .css .scss .json .xml .yaml .yml .md .txt .log .conf .config .env".split()
FILE_NAMES = "index main app config package readme dockerfile makefile gitignore env".split()
DIRECTORIES = "src lib bin test tests docs config assets public private node_modules venv".split()
TOPICS = {
    "function": ["function name", "function call", "function definition"],
    "class": ["class inheritance", "class methods", "class properties"],
    "import": ["import path", "import module", "import dependency"],
    "file": ["file path", "file content", "file dependency"],
}
#: Scores that differ by less than this are equal, and the newer file comes first.
ALIKE = 0.01


def filter_results(results: DataFrame, types: list[str] | None = None, path: str | None = None, least: float | None = None, directories: bool = True) -> DataFrame:
    """Results (``path, score, modified``, and ``kind`` where directories go) whose file
    name ends in one of ``types``, whose path holds ``path`` and whose score is enough."""
    low = F.lower("path")
    if types:
        results = results.where(low.rlike("(" + "|".join(t.lower().replace(".", r"\.") for t in types) + ")$"))
    if path:
        results = results.where(low.contains(path.lower()))
    if least:
        results = results.where(F.col("score") >= least)
    return results if directories else results.where("kind <> 'directory'")


def ranked(results: DataFrame, limit: int) -> DataFrame:
    """The best results: by score in steps of ``ALIKE``, then the newest, then by path."""
    return results.orderBy(F.floor(F.col("score") / ALIKE + 1e-9).desc(), F.desc("modified"), "path").limit(limit)


FIELDS = ("name", "path", "description")
# fixed values: weights of hybrid queries, and words that are no part of a path
HYBRID_WEIGHT, HYBRID_PARTS = 0.85, (1.0, 0.8, 0.6)
NO_PATH = ["文件", "file", "目录", "directory", "路径", "path"]
#: Files of each part of a query, their least score, and files of a whole query.
PART_RESULTS, LEAST_SCORE, MOST_RESULTS = 50, 0.7, 100
PART = "array<struct<part:int,field:string,text:string,weight:double,tag:string>>"


def file_index(files: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Files (``path, description, modified``) with their parts and a vector of each."""
    name = T.base_name(F.col("path"))
    one = files.where("path is not null").groupBy("path").agg(F.max_by("modified", F.coalesce("description", F.lit(""))).alias("modified"), F.coalesce(F.max("description"), F.lit("")).alias("description"))
    parts = one.select("path", name.alias("name"), T.directory(F.col("path")).alias("directory"), F.concat(F.lit("."), T.extension(F.col("path"))).alias("extension"), "description", "modified")
    return parts.withColumns({f"v_{f}": embed(F.col(f)) for f in FIELDS})


def query_parts(query: Column) -> Column:
    """What is looked for by each part of a query: the field, the text, its weight, and the
    extension that files must have."""
    q = F.trim(query)
    words = T.query_keywords(q)
    part = lambda i, field, text, weight=1.0, tag=None: F.struct(i.cast("int").alias("part"), F.lit(field).alias("field"), text.alias("text"), F.lit(weight).alias("weight"), (F.lit(None).cast("string") if tag is None else tag).alias("tag"))
    whole = lambda fields, weights: F.array(*[part(F.lit(i), f, q, w) for i, (f, w) in enumerate(zip(fields, weights))]).cast(PART)

    def each(texts: Column, field: str, tagged: bool = False) -> Column:
        """A part for every text, else one for the whole query."""
        parts = lambda x: F.transform(x, lambda w, i: part(i, field, w, 1.0, w if tagged else None)).cast(PART)
        return let(texts, lambda x: F.when(F.size(x) > 0, parts(x)).otherwise(whole([field], [1.0])))

    names = F.array_distinct(F.filter(F.split(F.lower(q), r"\s+"), lambda w: w.rlike(r"^[\w-]+(\.[\w-]+)+$")))
    places = F.filter(words, lambda w: ~w.startswith(".") & (F.length(w) > 2) & ~w.isin(NO_PATH))
    endings = F.filter(words, lambda w: w.startswith(".") & (F.length(w) > 1))
    kind = T.intent(q)[0]
    mixed = [HYBRID_WEIGHT * w for w in HYBRID_PARTS]
    return (
        F.when(kind == "EXACT_FILENAME", each(names, "name")).when(kind == "PATH_PATTERN", each(places, "path")).when(kind == "EXTENSION_SEARCH", each(endings, "name", tagged=True))
        .when(kind == "HYBRID_QUERY", whole(["description", "name", "path"], mixed)).otherwise(whole(["description", "name"], [1.0, 1.0]))
    )


def search_files(index: DataFrame, queries: DataFrame, embed: Callable[[Column], Column], least: float = LEAST_SCORE, k: int = PART_RESULTS, limit: int = MOST_RESULTS, types: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``query_id, rank, path, score, intent``: the files of every query (``query_id,
    query``), each once, in the order of ``ranked``."""
    asked = queries.where(F.trim("query") != "").select("query_id", F.explode(query_parts(F.col("query"))).alias("p")).select("query_id", "p.*")
    points = index.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("path").alias("id"), F.col("extension").alias("tag"), F.col(f"v_{f}").alias("v")) for f in FIELDS])).alias("x")).select("x.*")
    found = block_search(points, asked.select("query_id", "part", "field", "tag", embed(F.col("text")).alias("v")), k, least)
    weighed = found.join(asked.select("query_id", "part", "weight"), ["query_id", "part"]).select("query_id", F.col("id").alias("path"), F.struct("part", (F.col("score") * F.col("weight")).alias("score")).alias("first"))
    once = weighed.groupBy("query_id", "path").agg(F.min("first")["score"].alias("score"))
    rows = filter_results(once.join(index.select("path", "modified"), "path"), types, path)
    order = Window.partitionBy("query_id").orderBy(F.floor(F.col("score") / ALIKE + 1e-9).desc(), F.desc_nulls_last("modified"), "path")
    ranks = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranks.join(queries.select("query_id", T.intent(F.trim("query"))[0].alias("intent")), "query_id").select("query_id", "rank", "path", "score", "intent")


def file_suggestions(text: Column, limit: int = 10) -> Column:
    """Extensions that hold the typed text or are held by it, then names and directories."""
    low = F.lower(text)
    known = lambda values: F.array(*map(F.lit, values))
    kinds = F.transform(F.filter(known(EXTENSIONS), lambda x: F.contains(x, low) | F.contains(low, F.translate(x, ".", ""))), lambda x: F.concat(F.lit("*"), x))
    names = F.filter(known(FILE_NAMES), lambda x: F.contains(x, low))
    places = F.transform(F.filter(known(DIRECTORIES), lambda x: F.contains(x, low)), lambda x: F.concat(x, F.lit("/")))
    return F.slice(F.concat(kinds, names, places), 1, limit)


def topic_suggestions(text: Column, limit: int = 5) -> Column:
    low = F.lower(text)
    parts = [F.when(low.contains(k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in TOPICS.items()]
    return F.slice(F.concat(*parts), 1, limit)
