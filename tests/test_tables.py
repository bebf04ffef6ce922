"""Renames, cascades, error logs and groups of files, worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import changes, metrics
from lodestone.sources import files


def test_renames(spark):
    states = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 3), ("p", "d", 4), ("q", "a", 5), (None, "a", 6), ("p", None, 7), ("p", "e", 8), ("p", "f", 9)], "project_id string, path string, hash int")
    moves = [("p", "a", "b", 1), ("p", "b", "a", 1), ("p", "c", "x", 1), ("p", "c", "d", 2), ("p", "gone", "e", 1), (None, "a", "z", None), ("q", "a", None, 1), ("p", "e", "g", 3), ("p", "f", "g", 3)]
    got = changes.renamed(states, spark.createDataFrame(moves, "project_id string, old string, new string, at int"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([("p", "b", 1), ("p", "a", 2), ("p", "d", 3), ("q", "a", 5), (None, "z", 6), ("p", None, 7), ("p", "g", 8)], key=key)
    assert got.columns == states.columns


def test_cascade(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (None,)], "id int"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, a int"),
        "c": spark.createDataFrame([(10,), (11,), (12,), (None,)], "b int"),
    }
    links = [("b", "a", "a", "id"), ("c", "b", "b", "id")]
    left = changes.delete_cascading(tables, spark.createDataFrame([(1,), (1,), (9,), (None,)], "id int"), "a", links)
    assert {k: {r[0] for r in df.collect()} for k, df in left.items()} == {"a": {2, None}, "b": {11, 12}, "c": {11, 12, None}}
    with pytest.raises(ValueError):
        changes.delete_cascading(tables, spark.range(1), "a", links[::-1])


def test_error_log(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [(1, "high", "db", ["x"], False, at(1)), (2, "high", "db", ["y", "z"], True, at(3)), (3, "low", "db", [], None, at(2)), (4, None, None, None, None, None), (5, "high", "net", ["z"], False, at(3))]
    df = spark.createDataFrame(rows, "id int, level string, category string, tags array<string>, resolved boolean, at timestamp")
    ids = lambda **k: [r["id"] for r in metrics.error_log(df, **k).collect()]
    assert ids() == [2, 5, 3, 1, 4]
    assert ids(level="high", category="db") == [2, 1]
    assert ids(tags=["x", "z"]) == [2, 5, 1] and ids(tags=[]) == ids()
    assert ids(resolved=False) == [5, 1] and ids(since=at(2), until=at(2)) == [3]


def test_groups_of_files(spark):
    kb = 1024
    rows = [("a.ts", 300 * kb), ("b.py", 4 * kb), ("x/c.md", 10 * kb), ("d.txt", None), ("e.json", 1 * kb), ("noext", 2 * kb), (None, 1)]
    got = {r["grp"]: r for r in files.file_groups(spark.createDataFrame(rows, "path string, size long")).collect()}
    assert {k: (r["n"], r["total_size"]) for k, r in got.items()} == {"code-heavy": (2, 304 * kb), "documentation": (2, 10 * kb), "config": (1, kb), "miscellaneous": (1, 2 * kb)}
    assert got["code-heavy"]["languages"] == ["python", "typescript"]
    # 1.0 and 0.4 make 0.7; 152 KB a file are not small
    assert (got["code-heavy"]["complexity"], got["code-heavy"]["priority"], got["code-heavy"]["millis"]) == (0.7, 100, 7752)
    assert (got["documentation"]["priority"], got["miscellaneous"]["priority"]) == (100, 50 + 20 + 10 + 15)


def test_directories(spark):
    paths = {"/a/b/c/d/e.py": "b/c/d", "/a/b/e.py": "/a/b", "a\\b\\e.py": "a/b", "e.py": "", None: None}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["d"] for r in df.select("p", T.last_directories(F.col("p")).alias("d")).collect()} == paths
