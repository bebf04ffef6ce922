"""Innermost spans, ends of relations, usage edges and filtered hops against brute force."""

import random

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import spans as P
from lodestone.operators import structure as S


def test_innermost(spark):
    r = random.Random(1)
    spans = [(f, a, a + r.choice([0, 3, 40, 300]), f"n{i}", "k") for f in range(3) for i, a in enumerate(r.randint(1, 500) for _ in range(40))] + [(9, 5, 9, "same", "k"), (9, 5, 7, "short", "k")]
    uses = [(f, r.randint(1, 600), i) for f in range(4) for i in range(150)] + [(9, 6, 1), (9, 6, 1), (9, None, 2), (None, 6, 3)]
    got = P.innermost(spark.createDataFrame(uses, "f int, line int, x int"), spark.createDataFrame(spans, "f int, start_line int, end_line int, name string, kind string"), ("f",))

    def inner(f, line):
        # the latest begin, then the shortest
        around = [(a, -e) for g, a, e, _, _ in spans if g == f and line is not None and a <= line <= e]
        return (max(around)[0], -max(around)[1]) if around else (None, None)

    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((x["f"], x["line"], x["x"], x["owner_line"], x["owner_end"]) for x in got.collect()), key=key) == sorted(((f, n, x, *inner(f, n)) for f, n, x in uses), key=key)


def test_endpoints(spark):
    r = random.Random(2)
    entities = [(f, r.choice([r.randint(1, 200), 100]), f"e{i}") for f in range(3) for i in range(60)]
    relations = [(f, r.choice([r.randint(1, 220), 7]), i) for f in range(4) for i in range(80)] + [(None, 3, 1)]
    got = P.endpoints(spark.createDataFrame(relations, "f int, line int, x int"), spark.createDataFrame(entities, "f int, line int, id string"), ("f",)).collect()

    def ends(f, line):
        near = sorted((n, i) for g, n, i in entities if g == f and abs(n - line) <= 10)
        return (near[0][1], near[1][1]) if len(near) >= 2 else (None, None)

    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((x["f"], x["line"], x["x"], x["from_id"], x["to_id"]) for x in got), key=key) == sorted(((f, n, x, *ends(f, n)) for f, n, x in relations), key=key)


A = """class Shop {
  sell(item) {
    this.count = count(item);
    if (ready(this.name)) { log("sell(x)"); }
    const tell = () => {
      this.note(item.price(2)); // gone(1)
    };
  }
  note(text) { other(text); }
}
function count(x) {
  return count(x.n);
}"""
B = """class Bank:
    def note(self):
        return self.total + self.other()

def other(x):
    note(x)
"""


def test_usage_edges(spark):
    files = spark.createDataFrame([("a.ts", A), ("b.py", B), ("c", None)], "path string, code string")
    got = {(x["path"], x["src"], x["type"], x["dst_file"]["path"], x["dst"], x["dst_line"]) for x in S.usage_edges(files, "code", ("path",)).collect()}
    assert got == {
        ("a.ts", "sell", "CALLS", "a.ts", "count", 11), ("a.ts", "tell", "CALLS", "a.ts", "note", 9), ("a.ts", "note", "CALLS", "b.py", "other", 5), ("b.py", "note", "CALLS", "b.py", "other", 5), ("b.py", "other", "CALLS", "b.py", "note", 2),
        ("a.ts", "sell", "ACCESSES", "a.ts", "count", 1), ("a.ts", "sell", "ACCESSES", "a.ts", "name", 1), ("b.py", "note", "ACCESSES", "b.py", "total", 1),
    }


def test_filtered_hops(spark):
    r = random.Random(4)
    nodes = {i: r.randint(0, 9) for i in range(60)}
    edges = [(r.randrange(60), r.randrange(60), r.choice("ab"), r.randint(0, 9)) for _ in range(500)]
    n = spark.createDataFrame([(i, "T", f"n{i}", {"size": str(s)}) for i, s in nodes.items()], "id int, type string, name string, properties map<string,string>")
    e = spark.createDataFrame([(a, b, t, {"w": str(w)}) for a, b, t, w in edges], "src int, dst int, type string, properties map<string,string>")
    got = G.traverse(e, n, spark.createDataFrame([(0,), (1,)], "id int"), 3, ["a"], F.expr("properties['w'] >= '3'"), F.expr("properties['size'] >= '2'"), limit=15).collect()
    depth = {0: 0, 1: 0}
    for d in range(1, 4):
        for a, b, t, w in edges:
            if depth.get(a) == d - 1 and t == "a" and w >= 3 and nodes[b] >= 2:
                depth.setdefault(b, d)
    want = sorted((d, i) for i, d in depth.items() if d)[:15]
    assert [(x["depth"], x["id"]) for x in got] == want and len(want) > 5
