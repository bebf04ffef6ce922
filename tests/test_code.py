"""Code quality, structural groups and suggestions against plain Python."""

import random

from pyspark.sql import functions as F

from lodestone.functions import languages as L
from lodestone.operators import chunking as K
from lodestone.operators import code_quality as Q
from lodestone.operators import filesearch as S


def test_structural_groups_equal_brute_force(spark):
    r = random.Random(5)
    rows = []
    for doc in range(4):
        line = 1
        for chunk in range(40):
            n = r.randint(1, 12)
            rows.append((doc, chunk, line, line + n - 1, r.choice(["generic", "function"]), float(r.choice([0, 3, 4, 9])), r.choice([90, 100, 400])))
            line += n + r.choice([0, 0, 1, 20])
    df = spark.createDataFrame(rows, "doc_id int, chunk int, start_line int, end_line int, type string, complexity double, size int")

    def alike(a, b):
        share = lambda x, y: 1 - abs(x - y) / max(x, y) if max(x, y) > 0 else 0.0
        apart = b[2] - a[3]
        return 0.3 * (a[4] == b[4]) + 0.2 * share(a[5], b[5]) + 0.2 * share(a[6], b[6]) + (0.3 * (1 - apart / 50) if 0 <= apart <= 50 else 0.0)

    want = {}
    for doc in range(4):
        own = [x for x in rows if x[0] == doc]
        for i, a in enumerate(own):
            if (doc, a[1]) not in want:
                want[doc, a[1]] = a[1]
                for b in own[i + 1 :]:
                    if (doc, b[1]) not in want and alike(a, b) >= 0.8 - 1e-9:
                        want[doc, b[1]] = a[1]
    got = {(x["doc_id"], x["chunk"]): x["into"] for x in K.structural_groups(df).collect()}
    assert got == want and any(k[1] != v for k, v in got.items())


def test_quality_and_balance_of_code(spark):
    good = "// adds\nfunction addAll(a) {\n  return a;\n}"
    texts = [good, "class lower {\n", "function Bad_name() { TODO }", "{{{ }}}", 'x = "(" // (\n/* { */', "`a ${b}` `c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = {r["id"]: r for r in df.select("id", Q.chunk_quality(F.col("text")).alias("q"), Q.symbol_balance(F.col("text")).alias("b"), Q.indentation(F.col("text")).alias("i")).collect()}
    assert abs(rows[0]["q"] - (0.3 + 0.25 * 0.5 + 0.2 + 0.1 + 0.2)) < 1e-9
    assert abs(rows[1]["q"] - (0.1 + 0.2)) < 1e-9 and abs(rows[2]["q"] - (0.3 + 0.1)) < 1e-9 and abs(rows[3]["q"] - (0.3 + 0.2 + 0.2)) < 1e-9
    assert rows[4]["b"]["safe"] and not rows[5]["b"]["safe"] and rows[1]["b"]["curly"] == 1
    assert (rows[0]["i"]["style"], rows[0]["i"]["size"]) == ("spaces", 2.0) and rows[3]["i"]["style"] == "none"


def test_languages_and_lines(spark):
    texts = ["def f(x):\n    return self.x", "package main\nfunc main() { fmt.Print(len(x)) }", "interface A { readonly b: string }", "nothing here", "", "const f = require('x'); await g"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["l"]["language"] for r in df.select("id", L.language_of(F.col("text")).alias("l")).collect()}
    assert got == {0: "python", 1: "go", 2: "typescript", 3: "unknown", 4: "unknown", 5: "javascript"}
    lines = ["import x from 'y'", "  // note", "export class A {", "def go(x):", "}", "a + b"]
    kinds = spark.createDataFrame([(x,) for x in lines], "x string").select(L.line_kind(F.col("x")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["import", "comment", "class", "function", "end", "other"]


def test_suggestions(spark):
    row = spark.createDataFrame([("conf",)], "q string").select(S.file_suggestions(F.col("q")).alias("f"), S.topic_suggestions(F.lit("a Class of FILE")).alias("t")).first()
    assert row["f"] == ["*.c", "*.conf", "*.config", "config", "config/"]
    assert row["t"] == ["class inheritance", "class methods", "class properties", "file path", "file content"]


def test_structural_groups_run_no_rounds(spark):
    """Rounds of joins held the driver's memory for as long as chains of neighbours are."""
    rows = [(d, i, 4 * i + 1, 4 * i + 4, "x" * (20 + i % 3), "function", float(i % 2), 20 + i % 3) for d in (1, None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, chunk int, start_line int, end_line int, content string, type string, complexity double, size int")
    spark.sparkContext.setJobGroup("structural", "")
    found = K.structural_groups(df)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("structural")
    got = found.collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 1200 and {r["into"] == r["chunk"] for r in got if r["doc_id"] is None} == {True}
    assert any(r["into"] != r["chunk"] for r in got)
