"""Boundaries, rebalanced chunks and kinds of lines against plain Python."""

import random

from pyspark.sql import functions as F

from lodestone.functions import languages as L
from lodestone.functions.text import scan
from lodestone.operators import boundaries as B
from lodestone.operators import rebalance as R


def test_scan_gathers_all_states(spark):
    got = spark.range(600).selectExpr("sequence(1, cast(id as int)) as s", "id").where("id in (1, 255, 256, 257, 599)").select("id", scan(F.col("s"), F.lit(0), lambda a, x: a + x, lambda a: a, "int").alias("r")).collect()
    assert all(r["r"] == [k * (k + 1) // 2 for k in range(1, r["id"] + 1)] for r in got)


def test_kinds_of_lines(spark):
    want = {
        "import": ["import x from 'y'", "from a import b", "#include <x>", "using System;", "package a.b", "const f = require('f')", "use std::io;"],
        "comment": ["// x", "/* x */", "* @param a", "*/", "# note", "-- sql", "<!-- x -->"],
        "class": ["class A {", "export default class A", "public abstract class A", "interface B", "struct P {", "enum E", "impl Foo {", "type T = string", "pub trait X"],
        "function": ["function f() {", "export async function f(", "const f = (a) => a", "f: async (a) => {", "def f(x):", "func f(", "pub fn f()", "public int f(int a) {", "go(a, b) {", "go(a): string {"],
        "end": ["}", "});", "} // x", "end", "endif", "end function"],
        "other": ["x = 1", "go(a);", "important(a)", "classify it", "", "} else {"],
    }
    rows = [(k, "  " + x) for k, xs in want.items() for x in xs]
    for r in spark.createDataFrame(rows, "want string, x string").select("*", L.line_kind(F.col("x")).alias("k")).collect():
        assert r["k"] == r["want"], r["x"]


def test_languages_know_capitals(spark):
    texts = {"java": "public class A {\n  void f() { System.out.println(1); }\n", "csharp": "using System;\nnamespace N {\n List<int> a; Console.WriteLine(a);", "rust": "fn main() -> Option<String> { println!(1) }", "typescript": "class A extends B<C> { x: string[] }"}
    got = spark.createDataFrame(list(texts.items()), "want string, x string").select("want", L.language_of(F.col("x")).alias("l")).collect()
    assert all(r["l"]["language"] == r["want"] for r in got), got


def test_boundary_scores(spark):
    """A closing bracket ends a function, a class and a method; a blank line counts between
    definitions; an open bracket is no place to cut."""
    text = 'import a from "b";\n\nfunction f() {\n  g(\n    1);\n}\n// note\nconst a = 1;\n\nlet b = 2;\nx = "{";'
    docs = spark.createDataFrame([(1, text, "typescript"), (2, text, "c"), (3, text, None), (4, None, "c"), (5, "", "c")], "doc_id long, text string, lang string")
    rows = {(r["doc_id"], r["line"]): (round(r["score"], 6), r["depth"]) for r in B.boundary_lines(docs, F.col("lang")).collect()}
    w = {1: B.WEIGHTS["typescript"], 2: B.WEIGHTS["c"], 3: B.COMMON}
    for d in (1, 2, 3):
        s, f, c, m, i, g, n = w[d]
        safe = 0.3 * s
        want = [safe + 0.2 * i, safe + 0.5 * g, 0, 0, 0, safe + 0.4 * f + 0.4 * c + 0.35 * m, safe + 0.1 * n, safe, safe + 0.5 * g, safe, safe]
        # the line that only closes what the one before opened is not balanced itself
        assert [rows[d, k + 1][0] for k in range(11)] == [round(min(1.0, x), 6) for x in want]
        assert [rows[d, k + 1][1] for k in range(11)] == [0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0]
    assert (4, 1) not in rows and rows[5, 1] == (round(0.3 * 0.7, 6), 0)


def plain_rebalance(rows, least, most):
    """(start, end, content, type, language) of one document's chunks."""
    target = max(least, min(most, 0.8 * sum(len(r[2]) for r in rows) / len(rows)))
    out = []
    for start, end, content, kind, language in rows:
        lines = content.split("\n")
        if len(content) > most:
            if len(lines) == 1:
                size = int(target)
                out += [[start, start, content[i : i + size], kind, language] for i in range(0, len(content), size)]
                continue
            held, size, at = [], 0, start
            for line in lines:
                if size + len(line) + 1 > target and held:
                    out.append([at, at + len(held) - 1, "\n".join(held), kind, language])
                    at, held, size = at + len(held), [], 0
                held.append(line)
                size += len(line) + 1
            out.append([at, at + len(held) - 1, "\n".join(held), kind, language])
            continue
        small = len(content) < least and kind not in R.ALONE and not any(m in content for m in R.MARKS)
        last = out[-1] if out else None
        if small and last and len(last[2]) + len(content) <= most and last[4] == language and (last[3] == kind or any(last[3] in g and kind in g for g in R.TOGETHER)):
            last[1], last[2] = end, last[2] + "\n" + content
        else:
            out.append([start, end, content, kind, language])
    return [tuple(x) for x in out]


def test_rebalanced_chunks(spark):
    r = random.Random(3)
    docs = {}
    for doc in range(40):
        line, rows = 1, []
        for _ in range(r.randint(1, 12 if doc else 400)):
            n = r.choice([1, 1, 2, 5, 30])
            content = "\n".join(r.choice(["", "x", "word " * 4, "class A", "y" * 130, "a => b"]) for _ in range(n))
            rows.append((line, line + n - 1, content, r.choice(["code", "import", "function", "class", "method", "semantic", None]), r.choice(["ts", "ts", None])))
            line += n + r.choice([0, 2])
        docs[doc] = rows
    df = spark.createDataFrame([(d, i, *x) for d, rows in docs.items() for i, x in enumerate(rows)], "doc_id int, chunk int, start_line int, end_line int, content string, type string, language string")
    got = {}
    for x in R.rebalance(df, 60, 300).orderBy("doc_id", "chunk").collect():
        got.setdefault(x["doc_id"], []).append((x["start_line"], x["end_line"], x["content"], x["type"], x["language"]))
    for d, rows in docs.items():
        assert got[d] == plain_rebalance(rows, 60, 300), d
    assert R.rebalance(df.limit(0)).collect() == []
