"""Files, collections, streams and code graphs, with results worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import entities, vector
from lodestone.sources import files
from lodestone.sources.collections import PointStore
from lodestone.streaming import changes


def test_scan_and_changes(spark, tmp_path):
    root = tmp_path / "root"
    (root / "src" / ".git").mkdir(parents=True)
    (root / "node").mkdir()
    (root / "src" / "a.py").write_text("def f():\n    g()\n")
    (root / "src" / "b.bin").write_bytes(bytes(range(256)) * 8)
    (root / "src" / ".git" / "x").write_text("hidden")
    (root / "node" / "c.js").write_text("let x = 1")
    (root / "big.txt").write_text("x" * 600_000)
    got = {r["path"]: r for r in files.scan(spark, str(root), ignore="node/\n").collect()}
    assert set(got) == {"src/a.py", "src/b.bin"} and got["src/a.py"]["language"] == "python"
    assert got["src/b.bin"]["is_binary"] and got["src/b.bin"]["text"] is None and not got["src/a.py"]["is_binary"]
    every = files.scan(spark, str(root), most_bytes=None)
    assert {r["language"]: r["files"] for r in files.statistics(every).collect()}[None] == 4
    assert files.largest(every, 1).first()["path"] == "big.txt"
    known = spark.createDataFrame([("src/a.py", got["src/a.py"]["hash"]), ("node/c.js", "old"), ("gone", "x")], "path string, hash string")
    assert {(r["path"], r["change"]) for r in files.changed(every, known).collect()} == {("src/b.bin", "added"), ("big.txt", "added"), ("node/c.js", "modified")}


def test_binary_files(spark):
    """Known formats are told by their first bytes or their extension, others by what they hold."""
    rows = [
        (b"%PDF-1.7 all of it text", "x", True), (b"PK\x03\x04", "docx", True), (b"\x1f\x8b", None, True), (b"plain", "png", True), (b"SQLite format 3\x00", "x", True), (b"\x7fELF", "", True),
        (b"PK is no archive", "txt", False), (b"GIF", "md", False), ("naïve ünd größer".encode(), "txt", False), ("naïve".encode("latin-1") * 5, "txt", True), (b"a\x00b", "txt", True), (b"\x01\x02" * 9, "txt", True), (b"", "txt", False), (None, "txt", False), (b"\tx\r\n", None, False),
    ]
    df = spark.createDataFrame([(i, None if h is None else bytearray(h), e, w) for i, (h, e, w) in enumerate(rows)], "i int, head binary, ext string, want boolean")
    for r in df.select("i", "want", files.looks_binary(F.col("head"), F.coalesce("ext", F.lit(""))).alias("b")).collect():
        assert r["b"] == r["want"], rows[r["i"]]


def test_point_store(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "points"))
    make = lambda rows: spark.createDataFrame(rows, "id string, vector array<float>, language string")
    bad = store.upsert("a", make([("1", [1.0, 2.0], "py"), ("2", [1.0], "py"), ("3", [0.0, 1.0], "js"), (None, [1.0, 1.0], "c")]), 2)
    assert {r["id"] for r in bad.collect()} == {"2", None}
    store.upsert("b", make([("1", [5.0, 5.0], "go")]), 2)
    store.upsert("a", make([("1", [9.0, 9.0], "rs")]), 2)
    assert {(r["id"], r["language"]) for r in store.read("a").collect()} == {("1", "rs"), ("3", "js")}
    assert {(r["collection"], r["points"], r["size"]) for r in store.info().collect()} == {("a", 2, 2), ("b", 1, 2)}
    store.delete("a", spark.createDataFrame([("3",)], "id string"))
    assert [r["id"] for r in store.read("a").collect()] == ["1"]
    store.delete("a", spark.createDataFrame([("1",)], "id string"))
    assert {r["collection"] for r in store.info().collect()} == {"b"}


def test_created_collections(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "points"))
    assert store.listed().collect() == [] and store.create("project-x", 2) and store.create("y", 2, "euclid") and not store.create("project-x", 2)
    for wrong in (("project-x", 3), ("z", 0), ("z", 2, "far")):
        with pytest.raises(ValueError, match="size|distance"):
            store.create(*wrong)
    make = lambda rows: spark.createDataFrame(rows, "id string, vector array<float>, project_id string, at timestamp, day date")
    when = datetime(2024, 1, 2, 3, 4, 5)
    bad = store.put("project-x", make([("1", [1.0, 0.0], None, when, when.date()), ("2", [1.0, 1.0], "own", None, None), ("3", [1.0], "", when, None)]))
    store.put("y", make([("1", [3.0, 4.0], None, when, None), ("2", [0.0, 1.0], None, None, None)]))
    assert [r["id"] for r in bad.collect()] == ["3"]
    assert {(r["id"], r["project_id"], r["at"], r["day"]) for r in store.read("project-x").collect()} == {("1", "x", "2024-01-02T03:04:05.000Z", "2024-01-02"), ("2", "own", None, None)}
    assert [(r["id"], round(r["score"], 6)) for r in store.nearest("project-x", [1.0, 0.0], 1).collect()] == [("1", 1.0)]
    assert [(r["id"], r["score"]) for r in store.nearest("y", [0.0, 0.0]).collect()] == [("2", 1.0), ("1", 5.0)]
    with pytest.raises(ValueError, match="components"):
        store.nearest("y", [1.0])
    store.create("empty", 4, "dot")
    store.drop("y")
    assert {tuple(r) for r in store.listed().collect()} == {("project-x", 2, "cosine", 2), ("empty", 4, "dot", 0)}


def test_file_change_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    batches = [[("a", "add", "1", 0), ("a", "change", "1", 1), ("b", "change", "7", 2), ("c", "delete", None, 3)], [("a", "change", "2", 4), ("b", "delete", None, 5), ("b", "add", "8", 6)]]
    source, out = tmp_path / "in", tmp_path / "out"
    stream = None
    for rows in batches:  # the second run goes on where the first one stopped
        spark.createDataFrame([(p, k, h, t0 + timedelta(seconds=s)) for p, k, h, s in rows], "path string, kind string, hash string, at timestamp").write.mode("append").parquet(str(source))
        stream = changes.file_changes(changes.read(spark, str(source), "path string, kind string, hash string, at timestamp"))
        changes.run_to(stream, str(out), str(tmp_path / "point"))
    got = sorted((r["at"].second, r["path"], r["change"]) for r in spark.read.parquet(str(out)).collect())
    assert got == [(0, "a", "created"), (2, "b", "created"), (4, "a", "modified"), (5, "b", "deleted"), (6, "b", "created")]


def test_a_table_keeps_whole_versions(spark, tmp_path):
    at = str(tmp_path / "t")
    each = changes.into_table(at, ["k"], "n")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n int")
    each(rows(("a", 1), ("b", 1)), 0)
    each(rows(("a", 2)), 1)
    each(rows(("a", 3)), 2)
    (tmp_path / "t" / "v3").mkdir()  # begun, but never finished
    assert sorted(map(tuple, changes.table_at(spark, at).collect())) == [("a", 3), ("b", 1)]
    each(rows(("a", 3)), 2)  # again, after a failure
    assert sorted(map(tuple, changes.table_at(spark, at).collect())) == [("a", 3), ("b", 1)]


def test_bursts_and_windows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("u", t0 + timedelta(seconds=s), float(s)) for s in (0, 1, 2, 60, 61, 4000)]
    spark.createDataFrame(rows, "k string, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    read = lambda: changes.read(spark, str(tmp_path / "in"), "k string, ts timestamp, v double")
    changes.run_to(changes.bursts(read(), "ts", ["k"], "5 seconds"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "o1")).collect()) == [2, 3]
    changes.run_each(changes.measured(read(), "ts", ["k"], "v", "30 seconds"), changes.into_table(str(tmp_path / "o2"), ["k", "start"], "n"), str(tmp_path / "c2"))
    assert sorted((r["n"], r["mean"]) for r in changes.table_at(spark, str(tmp_path / "o2")).collect()) == [(1, 4000.0), (2, 60.5), (3, 1.0)]


def test_code_graph(spark):
    code = "import os\nclass A extends B implements C, D {\n}\ndef f():\n    g(1)\n    if (x): h()\ndef g():\n    pass\n"
    df = spark.createDataFrame([("m.py", code), ("n.py", "def h():\n  f()\n"), ("o.py", None)], "path string, text string")
    nodes, edges = entities.to_graph(df)
    names = {r["id"]: r["name"] for r in nodes.collect()}
    assert sorted(r["type"] for r in nodes.collect()) == ["Class", "File", "File", "File", "Function", "Function", "Function", "Import"]
    got = {(names[r["src"]], names[r["dst"]], r["type"]) for r in edges.collect()}
    assert {x for x in got if x[2] == "CALLS"} == {("f", "g", "CALLS"), ("f", "h", "CALLS"), ("h", "f", "CALLS")}
    assert ("m.py", "os", "IMPORTS") in got and ("m.py", "A", "CONTAINS") in got
    assert {(r["child"], r["parent"], r["type"]) for r in entities.inheritance(df).collect()} == {("A", "B", "INHERITS"), ("A", "C", "IMPLEMENTS"), ("A", "D", "IMPLEMENTS")}
    s, t = entities.ends_of(F.create_map(F.lit("fromNodeId"), F.lit("x"), F.lit("target"), F.lit("y")))
    assert tuple(spark.range(1).select(s, t).first()) == ("x", "y")


def test_approximate_search_has_recall(spark):
    """2,000 vectors without any structure; a recall of 0.9 or more of the exact ten."""
    import numpy as np

    x = np.random.default_rng(4).standard_normal((2000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [0.0] * 64)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = vector.approximate_search(df, asked).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 2000, 50):
        near = unit @ unit[q]
        near[q] = -2
        hit += len(set(np.argsort(-near)[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == 400 and hit >= 0.9 * 400
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in vector.batch_search(df, asked).collect()}
    assert all(abs(exact.get((r["query_id"], r["vec_id"]), r["score"]) - r["score"]) < 1e-9 for r in got)


def test_batch_search_meets_in_tiles(spark):
    """Equal vectors tie by id, odd ones are compared as before, and no pair is a row."""
    import numpy as np

    x = np.random.default_rng(5).standard_normal((300, 8)).tolist()
    x[7], x[9], x[11] = x[100], x[100], [0.0] * 8
    x += [None, [1.0] * 7 + [None], [float("nan")] * 8]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for measure in ("cosine", "dot"):
        found = vector.batch_search(df, asked, 5, measure)
        assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().toString()
        f = vector.MEASURES[measure][0]
        want = {}
        for r in df.crossJoin(asked).where("vec_id <> query_id").select("query_id", "vec_id", f(F.col("embedding"), F.col("query")).alias("s")).collect():
            # nulls last, no numbers first
            want.setdefault(r["query_id"], []).append((np.inf if r["s"] is None else -np.inf if np.isnan(r["s"]) else -round(r["s"], 12), r["vec_id"]))
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == {q: [i for _, i in sorted(rows)[:5]] for q, rows in want.items()}
