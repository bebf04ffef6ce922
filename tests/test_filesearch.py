"""File search: what a query asks for, and results against plain Python."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from lodestone.operators import filesearch as S
from lodestone.operators import vector as V

EMBED = V.EMBEDDERS["hashed"]
FILES = [
    ("/src/auth/login_service.ts", "checks users and passwords", 10), ("/src/auth/user_login.ts", "login of users", 30), ("/docs/login/index.md", "how to log in", 20), ("/src/db/index.ts", "tables", None),
    ("/src/db/user.py", None, 5), ("config.json", "settings", 7), ("/a\\b//README", "read me first", 8), (None, "no path", 1), ("/src/db/user.py", "users of the base", 9),
]


def vector(text):
    v = [0] * 64
    for w in re.split(r"[\W_]+", text.lower()):
        if w:
            v[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64] += 1
    return v


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0


ASKED = [
    ("user_login.ts", "EXACT_FILENAME", [("name", "user_login.ts", 1.0, None)]),
    ("files with extension .ts", "EXTENSION_SEARCH", [("name", ".ts", 1.0, ".ts")]),
    ("find all typescript files", "EXTENSION_SEARCH", [("name", "find all typescript files", 1.0, None)]),
    ("files in directory auth", "PATH_PATTERN", [("path", "files", 1.0, None), ("path", "auth", 1.0, None)]),
    ("在 db 目录下", "EXACT_FILENAME", [("name", "在 db 目录下", 1.0, None)]),
    ("关于 login", "SEMANTIC_DESCRIPTION", [("description", "关于 login", 1.0, None), ("name", "关于 login", 1.0, None)]),
    ("find .md", "HYBRID_QUERY", [("description", "find .md", 0.85, None), ("name", "find .md", 0.68, None), ("path", "find .md", 0.51, None)]),
    ("login", "EXACT_FILENAME", [("name", "login", 1.0, None)]),
    (" ", None, []),
    (None, None, []),
]


def test_search(spark):
    queries = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(ASKED)], "query_id long, query string")
    parts = {r["query_id"]: [(p["field"], p["text"], round(p["weight"], 9), p["tag"]) for p in r["p"]] for r in queries.where("trim(query) <> ''").select("query_id", S.query_parts(F.col("query")).alias("p")).collect()}
    index = S.file_index(spark.createDataFrame(FILES, "path string, description string, modified int"), EMBED)
    rows = S.search_files(index, queries, EMBED, least=0.4).orderBy("query_id", "rank").collect()
    files = {p: (d or "", m) for p, d, m in FILES if p}
    for i, (_, kind, want_parts) in enumerate(ASKED):
        assert parts.get(i, []) == want_parts
        first = {}
        for field, text, weight, tag in want_parts:
            for p, (d, _) in files.items():
                name = p.replace("\\", "/").rsplit("/", 1)[-1]
                score = cosine(vector(text), vector({"name": name, "path": p, "description": d}[field]))
                if score >= 0.4 and (tag is None or name.endswith(tag)):
                    first.setdefault(p, score * weight)
        want = sorted(first, key=lambda p: (-math.floor(first[p] / 0.01 + 1e-9), -(files[p][1] if files[p][1] is not None else -1), p))
        own = [r for r in rows if r["query_id"] == i]
        assert [r["path"] for r in own] == want and all(r["intent"] == kind and abs(r["score"] - first[r["path"]]) < 1e-9 for r in own)
    assert {r["query_id"] for r in rows} >= {0, 1, 3, 5}


def test_blocks_and_shards_give_the_same(spark, monkeypatch):
    index = S.file_index(spark.createDataFrame([(f"/s/{i % 7}_{i % 11}_{i}.ts", f"text {i % 13}", i % 5) for i in range(300)], "path string, description string, modified int"), EMBED).cache()
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["find 3", "search about text 4", "5_6_.ts", "files with extension .ts"])], "query_id long, query string")
    rows = lambda: sorted(map(tuple, S.search_files(index, asked, EMBED, least=0.3, k=6).collect()))
    whole = rows()
    monkeypatch.setattr(V, "SHARD_POINTS", 50)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 2)
    assert rows() == whole and len(whole) > 10


def test_nothing_to_search(spark):
    index = S.file_index(spark.createDataFrame([], "path string, description string, modified int"), EMBED)
    assert S.search_files(index, spark.createDataFrame([(1, "a.ts")], "query_id long, query string"), EMBED).collect() == []
