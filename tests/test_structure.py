"""Definitions, structure chunks and tags against plain Python versions of them."""

import random
import re

from pyspark.sql import functions as F

from lodestone.operators import chunking as K
from lodestone.operators import structure as S


def made(r, brackets):
    """A random tree of definitions as text, and its spans as they were made."""
    lines, want = [], []

    def put(level, parent, blank):
        name = f"n{len(lines)}"
        begin = len(lines) + 1
        row = [None, name, begin, None, level, parent]
        want.append(row)
        if brackets:
            kind, head = r.choice([("class", f"export class {name} {{"), ("function", f"function {name}(a, b) {{"), ("method", f"async {name}(a: number): void {{"), ("function", f"const {name} = (a) => {{"), ("interface", f"interface {name} {{"), ("method", f"public int {name}(int a)"), ("struct", f"pub struct {name}"), ("function", f"function {name}("), ("namespace", f"namespace {name} {{ // {{")])
            lines.append(blank + head)
            if not head.rstrip("/ {").endswith(("{",)) and "{" not in head:
                if head.endswith("("):
                    lines.extend([blank + "  a,", blank + ") {"])
                else:
                    lines.append(blank + "{")
        else:
            kind, head = r.choice([("class", f"class {name}(A):"), ("function", f"def {name}(a, b) -> int:"), ("function", f"async def {name}(a):"), ("function", f"def {name}(")])
            lines.append(blank + head)
            if head.endswith("("):
                lines.extend([blank + "    a,", blank + "):"])
        row[0] = kind
        inner = blank + r.choice(["  ", "    "])
        for _ in range(r.randint(1, 4)):
            kind_ = r.random()
            if kind_ < 0.35 and level < 6:
                put(level + 1, begin, inner)
            elif brackets:
                lines.extend([[inner + "if (a) {", inner + "  go();", inner + "} else {", inner + "}"], [inner + 'x = "}{" + \'{\'; // }'], [inner + "/* {", "} class no {", inner + "*/"], [""], [inner + "call(a, b);"], [inner + "y = { a: 1 };"]][r.randrange(6)])
            else:
                lines.extend([[inner + "if a:", inner + "  go()"], [inner + 'x = "def no():"  '], [inner + '"""text', "def no():", '"""'], [""], [inner + "# def no():", inner + "pass"], [inner + "return a(", inner + "  b)"]][r.randrange(6)])
        if not brackets:
            lines.append(inner + "pass")
            row[3] = len(lines)
            lines.extend([""] * r.randint(0, 2))
        else:
            lines.append(blank + "}")
            row[3] = len(lines)

    for _ in range(r.randint(1, 3)):
        put(0, None, "")
        lines.extend(r.choice([[], [""], ["use(it)" + ";" * brackets]]))
    return "\n".join(lines), [tuple(x) for x in want]


def test_definitions_of_random_trees(spark):
    texts = [made(random.Random(i), i % 2 == 0) for i in range(80)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, (t, _) in enumerate(texts)], "doc_id long, text string, name string, level int")
    got = {}
    for r in S.definitions(df).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r[c] for c in ("kind", "name", "start_line", "end_line", "level", "parent_line")))
    for i, (_, want) in enumerate(texts):
        assert sorted(got[i], key=lambda x: x[2]) == sorted(want, key=lambda x: x[2]), (i, texts[i][0])


def test_chunks_of_random_trees(spark):
    texts = [made(random.Random(100 + i), i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(90, None), (91, ""), (92, " \n\t"), (93, "no code\nat all")], "doc_id long, text string")
    got = {}
    for r in S.structure_chunks(df, most_level=2, least_chars=40, most_chars=300).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk"], r["kind"], r["name"], r["start_line"], r["end_line"], r["content"]))
    for i, (text, want) in enumerate(texts):
        lines = text.split("\n")
        right = [(k, n, a, b, "\n".join(lines[a - 1 : b])) for k, n, a, b, level, _ in sorted(want, key=lambda x: x[2]) if level <= 2 and 40 <= len("\n".join(lines[a - 1 : b])) <= 300]
        assert sorted(got[i]) == [(j, *x) for j, x in enumerate(right or [("generic", None, 1, len(lines), text)])]
    assert not {90, 91, 92} & set(got) and got[93] == [(0, "generic", None, 1, 2, "no code\nat all")]


def plain_depths(text):
    """Open elements behind each line, character by character."""
    names, state, out, i, name, quote = [], "text", [], 0, "", ""
    while i < len(text):
        c = text[i]
        if c == "\n":
            out.append(len(names))
        if state == "note":
            if text.startswith("-->", i):
                state, i = "text", i + 2
        elif state == "tag":
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == ">":
                state = "text"
                if text[i - 1] == "/" or name in K.VOID:
                    names.pop()
                elif name in K.RAW:
                    state = name
        elif state in K.RAW:
            if text[i:].lower().startswith(f"</{state}"):
                names.pop()
                i, state = text.index(">", i), "text"
        elif text.startswith("<!--", i):
            state, i = "note", i + 3
        elif m := re.match(r"</([A-Za-z][\w:.-]*)[^<>\n]*>", text[i:]):
            if m[1].lower() in names:
                while names.pop() != m[1].lower():
                    pass
            i += len(m[0]) - 1
        elif m := re.match(r"<([A-Za-z][\w:.-]*)", text[i:]):
            name, state = m[1].lower(), "tag"
            names.append(name)
            i += len(m[0]) - 1
        i += 1
    return [*out, len(names)]


def page(seed):
    r = random.Random(seed)
    part = lambda: r.choice(["<a>", "</a>", "<B class='x>y'>", "</b>", "<br>", "<img src=\"a\"/>", "<p>", "</p >", "text", "\n", "\n", "<!-- <a> -->", "<!-- <b>\n</a> -->", "<script>var a='<b>';\n if (a<b) x();</script>", "<style>\np{}</STYLE>", "<ns:c\n  id='1'\n>", "<d\n e='f'/>", "</zz>", "<!DOCTYPE html>", "a < b", "<INPUT\nname=x>"])
    return "".join(part() for _ in range(r.randint(0, 80)))


def test_tag_depths(spark):
    texts = [page(i) for i in range(120)] + ["", "<a>\n" * 600 + "</a>\n" * 600, "<a><b>\n</b>\n</a>", "<a>\n</b>\n</a>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("i", K.tag_depths(F.col("text")).alias("d")).collect():
        assert r["d"] == plain_depths(texts[r["i"]]), texts[r["i"]]


def test_chunks_end_with_elements(spark):
    wide = "x" * 220
    texts = ["<a>\n<b>" + wide + "\n</a>\n<c>\n</c>", "<a>\n" + wide + "\n</b>\n</a>\nz", "<p>\n<br>\n" + wide + "\n</p>\nq", "".join(f"<e{i}>\n" for i in range(25))]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    got = {}
    for r in K.chunks(df, K.xml_ends(F.col("text"))).collect():
        got.setdefault(r["doc_id"], []).append((r["start_line"], r["end_line"]))
    # an end of another name ends nothing, one of the right name ends what was left open too
    assert sorted(got[0]) == [(1, 3), (4, 5)] and sorted(got[1]) == [(1, 4), (5, 5)] and sorted(got[2]) == [(1, 4), (5, 5)]
    assert sorted(got[3])[:2] == [(1, 11), (12, 22)] and 9 not in got


def test_uses_know_their_owners_without_a_join(spark):
    """As the joins by blocks of lines have it, but nothing is shuffled."""
    from lodestone.operators import spans as P

    df = spark.createDataFrame([(i, made(random.Random(i), i % 2 == 0)[0]) for i in range(40)] + [(40, None), (41, "a()\r\nb(); self.c")], "doc_id long, text string")
    uses, found = S.uses(df), S.definitions(df)
    rows = lambda d, *cols: sorted((tuple(r) for r in d.select("doc_id", "line", "does", "name", *cols).collect()), key=repr)
    owner = ("owner_line", "owner_end", "owner_name", "owner_kind")
    owned, ended = S.owned_uses(df), S.ended_uses(df)
    assert rows(owned, *owner) == rows(P.innermost(uses, found, ("doc_id",)), *owner)
    ids = found.select("doc_id", F.col("start_line").alias("line"), F.concat("kind", F.lit(":"), "name").alias("id"))
    assert rows(ended, "from_id", "to_id") == rows(P.endpoints(uses, ids, ("doc_id",)), "from_id", "to_id")
    assert not any("Exchange" in d._jdf.queryExecution().toString() for d in (owned, ended))


def test_machine_is_fast_over_many_lines(spark):
    """200,000 lines took over 20 s as a fold of Spark expressions."""
    import time

    text = "\n".join(f"function f{i % 900}() {{\n  step({i % 7});\n  x = \"}}\"; // {{\n}}" for i in range(50_000))
    began = time.perf_counter()
    assert len(S.text_spans(text)) == 50_000 and len(S.text_owned_uses(text)) == 50_000
    assert time.perf_counter() - began < 10
