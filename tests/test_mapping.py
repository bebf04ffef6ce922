"""Nodes and edges from parsed rows and raw results, and their checks, worked out by hand."""

from pyspark.sql import functions as F

from lodestone.operators import mapping as M

PARSED = "id string, type string, name string, path string, line int, data string"


def test_relations_by_kind(spark):
    """Every relation has its edge type, its ends and the property for its own type."""
    data = '{"source":"a","target":"b","fromNodeId":"c","toNodeId":"d","type":"t"}'
    df = spark.createDataFrame([(k, k, "n", "p", 1, data) for k in M.RELATIONS], PARSED)
    for r in M.to_edges(df).collect():
        kind, own = M.RELATIONS[r["id"]]
        assert r["type"] == kind
        assert (r["src"], r["dst"]) == (("c", "d") if r["id"] in ("call", "data-flow") else ("a", "b"))
        assert r["properties"] == {"source": "a", "target": "b", "fromNodeId": "c", "toNodeId": "d", "type": "t"} | ({own: "t"} if own else {})


def test_relations_that_lack_something(spark):
    rows = [
        ("1", "reference", '{"source":"a"}'), ("2", "reference", None), ("3", "reference", "{"), ("4", "friend", '{"source":"a"}'), ("5", None, '{"source":"a"}'),
        ("6", "semantic", '{"source":"a","target":"b","type":"x","semanticType":"own"}'), ("7", "creation", "{}"), ("8", "creation", '{"source":{"k":1},"target":""}'),
    ]
    df = spark.createDataFrame([(i, k, None, None, None, d) for i, k, d in rows], PARSED)
    got = {r["id"]: (r["src"], r["dst"], r["properties"]) for r in M.to_edges(df).collect()}
    assert got == {
        "1": ("a", None, {"source": "a"}), "6": ("a", "b", {"source": "a", "target": "b", "type": "x", "semanticType": "own"}), "7": (None, None, {}), "8": ('{"k":1}', "", {"source": '{"k":1}', "target": ""}),
    }
    assert M.to_nodes(df).count() == 0
    assert M.to_edges(df.where("false")).count() == 0


def test_entities(spark):
    df = spark.createDataFrame([(k, k, None, "p", 1, None) for k in ["class", "enum", "type", "call", "x"]], PARSED)
    assert {r["id"]: r["type"] for r in M.to_nodes(df).collect()} == {"class": "Class", "enum": "Chunk", "type": "Property"}


def test_spellings_of_nodes(spark):
    rows = {
        '{"id":1,"type":"A","name":"n","properties":{"b":[1]}}': ("1", "A", "n", '{"b":[1]}'),
        '{"_id":"1","label":"A"}': ("1", "A", "A", "{}"),
        '{"vertex":{"id":"1","tag":"A","props":{}}}': ("1", "A", "A", "{}"),
        '{"vertex":{"_vid":"1","_tag":"A"}}': ("1", "A", "A", "{}"),
        '[{"id":"1","name":""}]': ("1", "unknown", "unknown", "{}"),
        '{"id":null,"_id":"1","type":"","tag":"T"}': ("1", "T", "T", "{}"),
        "[]": ("unknown",) * 3 + ("{}",), "7": ("unknown",) * 3 + ("{}",), "no json": ("unknown",) * 3 + ("{}",), "": ("unknown",) * 3 + ("{}",), None: ("unknown",) * 3 + ("{}",),
    }
    df = spark.createDataFrame([(k, "x") for k in rows], "row string, id string")
    assert sorted(tuple(r) for r in M.normal_nodes(df).collect()) == sorted(rows.values())


def test_spellings_of_edges(spark):
    rows = {
        '{"id":1,"edgeType":"A","src":"s","dst":"d"}': ("1", "A", "s", "d", "{}"),
        '{"edge":{"_edgeId":"1","name":"A","from":"s","to":"d","props":{"w":2}}}': ("1", "A", "s", "d", '{"w":2}'),
        '[{"_id":"1","type":"A","source":"s"}]': ("1", "A", "s", "unknown", "{}"),
    }
    df = spark.createDataFrame([(k,) for k in rows], "row string")
    assert sorted(tuple(r) for r in M.normal_edges(df).collect()) == sorted(rows.values())


def test_node_errors(spark):
    fine = '{"name":"n","path":"p","language":"l","size":0,"lastModified":"x","projectId":null}'
    rows = [
        ("a", "File", fine, []), (None, "File", fine, ["no id"]), ("b", None, "{}", ["type null"]), ("c", "Chunk", None, ["no properties"]), ("d", "Chunk", "[1]", ["no properties"]), ("e", "Chunk", "{", ["no properties"]),
        ("f", "File", fine.replace("0", "-1"), ["bad size"]), ("g", "File", fine.replace("0", '"0"'), ["bad size"]), ("h", "File", fine.replace("0", "0.5"), []), ("i", "Import", '{"name":""}', ["bad name", "missing path"]),
        ("j", "Class", '{"name":"n","methods":[],"properties":{},"parentFileId":1}', ["bad properties"]), ("k", "Variable", '{"name":1,"type":"t","scope":null}', ["bad name"]), ("l", "Import", None, ["no properties"]),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id string, type string, properties string")
    got = sorted((r["id"] or "", r["errors"]) for r in M.node_errors(df).collect())
    assert got == sorted((r[0] or "", r[3]) for r in rows)
    assert {e for r in M.node_errors(df, {"Chunk": {"k": "count"}}).where("id in ('a', 'j')").collect() for e in r["errors"]} == set()


def test_edge_errors(spark):
    nodes = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "id string")
    rows = [("1", "CALLS", "a", "b", "{}", []), ("", "CALLS", "a", "a", "{}", ["no id"]), ("2", "calls", None, "z", None, ["type calls", "no src", "dst not there: z", "no properties"])]
    df = spark.createDataFrame([r[:5] for r in rows], "id string, type string, src string, dst string, properties string")
    got = M.edge_errors(df, nodes)
    assert got.columns == [*df.columns, "errors"]
    assert sorted((r["id"], r["errors"]) for r in got.collect()) == sorted((r[0], r[5]) for r in rows)
    assert M.edge_errors(df, nodes.where("false")).where(F.size("errors") == 0).count() == 0
