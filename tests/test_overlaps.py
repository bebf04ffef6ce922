"""Overlap strategies against plain Python."""

import random
import re

from pyspark.sql import functions as F

from lodestone.functions import languages as L
from lodestone.operators import boundaries as B
from lodestone.operators import overlaps as O

LINES = ["", "}", "// note", "function f() {", "const a = 1;", "  call(b", "import x from 'y'", "class A {", "word " * 12, ")", "return x;", "if (a) {"]


def backwards(content, rule):
    held, stop = [], False
    for x in reversed(content.split("\n")):
        if not stop:
            take, stop = rule(x, held)
            held = [x, *held] if take else held
    return held


def by_size(c):
    def rule(x, held):
        size = sum(len(y) + 1 for y in held) + len(x) + 1
        return size <= 200, size > 200 or size / len(c) > 0.3

    return backwards(c, rule)


def by_syntax(c):
    def rule(x, held):
        full = len("\n".join(held)) >= 200
        return not full, full or len("\n".join([x, *held])) / len(c) > 0.3

    return backwards(c, rule)


def by_meaning(c, score, signature):
    def rule(x, held):
        full, part = len("\n".join(held)) >= 200, len("\n".join([x, *held])) / len(c)
        want = score[x] > 0.6 or len(held) < 1 or (signature[x] and part <= 0.3)
        return not full and want and (part <= 0.3 or not held), full

    return backwards(c, rule)


def quality(lines, starts):
    if not lines:
        return 0.0
    first, last = lines[0].strip(" "), lines[-1].strip(" ")
    says = sum(x.strip(" ") != "" and not x.strip(" ").startswith(("//", "/*")) for x in lines)
    return min(1.0, 0.3 * starts[lines[0]] + 0.2 * bool(re.fullmatch(r"[}\])];?", last)) + 0.1 * first.startswith(("//", "/*")) + 0.2 * (len(lines) < 10) + 0.2 * (2 * says > len(lines)))


def test_strategies(spark):
    r = random.Random(1)
    chunks = ["\n".join(r.choice(LINES) for _ in range(r.randint(1, 40))) for _ in range(60)] + ["x" * 500, "a\n" * 300]
    one = spark.createDataFrame([(x,) for x in {y for c in chunks for y in c.split("\n")}], "x string")
    none = F.lit(None).cast("string")
    x = F.col("x")
    known = {k["x"]: k for k in one.select("x", B.boundary_score(x, none, none, F.lit("typescript")).alias("s"), L.is_kind(x, "function").alias("f"), (L.is_kind(x, "function") | L.is_kind(x, "class")).alias("b")).collect()}
    score, signature, starts = ({k: v[c] for k, v in known.items()} for c in "sfb")
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chunks) if c], "i int, c string")
    c = F.col("c")
    got = df.select("i", O.by_size(c).alias("size"), O.by_syntax(c).alias("syntax"), O.by_meaning(c, F.lit("typescript")).alias("meaning"), O.hybrid(c, F.lit("typescript")).alias("best")).collect()
    kinds = set()
    for g in got:
        text = chunks[g["i"]]
        want = {"meaning": by_meaning(text, score, signature), "syntax": by_syntax(text), "size": by_size(text)}
        assert {k: g[k] for k in want} == want, text
        name = max(want, key=lambda k: (round(quality(want[k], starts), 9), -list(want).index(k)))
        assert g["best"] == want[name], (text, want)
        kinds.add(name)
    assert len(kinds) > 1


def test_neighbours(spark):
    """A gap with a definition is handed on whole, one without is not; alike neighbours get
    what has meaning, and the last chunk hands on nothing."""
    code = ["function a() {", "  return 1;", "}", "function gap() {", "  return 2;", "}", "const b = 3;", "", "", "const c = 4;", "// end of it", "const c = 4;", "// end of it"]
    file = "\n".join(code)
    cut = lambda a, b: "\n".join(code[a - 1 : b])
    rows = [(1, 0, 1, 3, cut(1, 3)), (1, 1, 7, 7, cut(7, 7)), (1, 2, 10, 11, cut(10, 11)), (1, 3, 12, 13, cut(12, 13)), (2, 0, 1, 1, "alone"), (3, 0, 1, 1, "no file " * 30), (3, 1, 2, 2, "to look at " * 30)]
    files = spark.createDataFrame([(1, file, "typescript"), (2, "alone", None)], "doc_id int, text string, language string")
    got = {(r["doc_id"], r["chunk"]): (r["strategy"], r["overlap"]) for r in O.overlaps(spark.createDataFrame(rows, "doc_id int, chunk int, start_line int, end_line int, content string"), files).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (3, 0)}
    # chunks as small as these go by what they repeat
    assert got[1, 0][0] == "smart-dedup" and got[1, 2] == ("smart-dedup", "// end of it")
    assert got[3, 0] == ("ast-boundary", "no file " * 30) or got[3, 0][0] in ("hybrid", "ast-boundary", "node-aware")
    wide = [(1, 0, 1, 3, cut(1, 3) + " " * 200), (1, 1, 7, 7, cut(7, 7)), (1, 2, 10, 11, cut(10, 11) + " " * 200)]
    got = {r["chunk"]: (r["strategy"], r["overlap"]) for r in O.overlaps(spark.createDataFrame(wide, "doc_id int, chunk int, start_line int, end_line int, content string"), files).collect()}
    assert got[0] == ("node-aware", cut(4, 6)) and got[1] == ("node-aware", "const b = 3;")


def test_only_ends_of_functions_are_good_places(spark):
    """Lines without neighbours: other factors never come to more than a good place needs."""
    assert all(sum(w[i] * B.SHARES[i] for i in (0, 4, 6)) < O.GOOD for w in [*B.WEIGHTS.values(), B.COMMON])
    lines = [*LINES, "};", "}\t", "end", "endif", "export x", "=> { a }", "# c", "} // e", "import a"]
    df = spark.createDataFrame([(x, k) for x in lines for k in (*B.WEIGHTS, "none", None)], "x string, k string")
    none = F.lit(None).cast("string")
    got = df.select("x", O.good_place(F.col("x"), F.col("k")).alias("good"), (B.boundary_score(F.col("x"), none, none, F.col("k")) > O.GOOD).alias("want")).collect()
    assert all(r["good"] == r["want"] for r in got) and len({r["good"] for r in got}) == 2


def test_files_meet_their_chunks_once(spark):
    """Chunks, owners and marks come from one row a file, so no more than chunks and files
    are dealt out and lines meet no definitions by joins; repeated chunks count apart."""
    import contextlib
    import io

    from lodestone.catalog import queries

    text = "class A {\n  m() {\n    a();\n  }\n\n  n() {\n    b();\n  }\n}"
    files = spark.createDataFrame([(1, text, "typescript"), (2, None, None)], "doc_id int, text string, language string")
    lines = text.split("\n")
    rows = [(1, i, a, b, "\n".join(lines[a - 1 : b])) for i, (a, b) in enumerate([(1, 4), (6, 8), (9, 9)])]
    held = O.near_chunks(text, [1, 6, 9], [4, 8, 9])
    assert [(x["owner_end"], x["marks"], x["gap"]) for x in held] == [(4, [1, 2, 4, 6], None), (8, [6, 8, 9], None), (9, [9], None)]
    assert O.near_chunks(None, [1, 2], [1, 2])[0] == {"owner_end": None, "marks": [], "gap": None}
    assert O.near_chunks("a\nfunction f() {\n}\nb", [1, 4], [1, 4])[0]["gap"] == ["function f() {", "}"]
    found = O.overlaps(spark.createDataFrame([*rows, rows[1]], "doc_id int, chunk int, start_line int, end_line int, content string"), files)
    assert found.count() == 3
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        found.explain()
    assert shown.getvalue().count("Join") == 1 and "chunk_overlaps" in queries()


def test_texts_hand_on_without_a_shuffle(spark):
    """Chunks of a rule and their overlaps come from one pass over each text: the same as by
    way of rows of chunks, and neither dealt out nor joined."""
    import contextlib
    import io

    from lodestone.operators import chunking as K

    r = random.Random(3)
    lines = [*LINES, "{", "}}}", "<b>", "</b>", "def g():", "    y = (1", "\t};\r", "sé {", '"}" // {', "  // note"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(1, 120))) for _ in range(60)] + ["", " \n", None, "{\n" * 70, "x" * 4000 + "\ny"]
    files = spark.createDataFrame([(i, x, r.choice([*B.WEIGHTS, "none", None])) for i, x in enumerate(texts)], "doc_id int, text string, language string")
    got = O.text_overlaps(files, K.text_bracket_ends)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "chunk", "strategy", "overlap", "quality").collect()))
    want = rows(O.overlaps(K.chunks(files, K.bracket_ends(F.col("text"))), files))
    assert rows(got) == want and len({x[2] for x in want}) > 2
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        got.explain()
    assert "Join" not in shown.getvalue() and "Exchange" not in shown.getvalue()


def test_lines_alone_score_as_columns_do(spark):
    """The helper of one line and the expression over lines are one rule."""
    lines = [*LINES, "", " ", "\t}\r", "};  // x", "end", "endif", "export x", "x => { a }", "# c", "-- c", "(a", "'(' )", "/* ( */ )", "`a", "`a` {}", "importé x", "functioné(", "require('x')", "} ", "a }", "é {", '"\\"(" + "', "//(\n".strip()]
    kinds = [*B.WEIGHTS, "none", "TypeScript", None]
    df = spark.createDataFrame([(x, k) for x in lines for k in kinds], "x string, k string")
    none = F.lit(None).cast("string")
    for row in df.select("x", "k", B.boundary_score(F.col("x"), none, none, F.col("k")).alias("s"), L.is_kind(F.col("x"), "function").alias("f"), L.is_kind(F.col("x"), "class").alias("c")).collect():
        assert (B.line_scores(row["k"])[row["x"]], B.line_is(row["x"], "function"), B.line_is(row["x"], "class")) == (row["s"], row["f"], row["c"]), row
