"""Chunk rules against plain Python versions of them."""

import random

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking as K


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spans(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk"])):
        out.setdefault(r["doc_id"], []).append((r["start_line"], r["end_line"], r["content"]))
    return out


def plain_lines(text, most_lines, most_chars):
    lines, ends, start = text.split("\n"), [], 0
    for i in range(len(lines)):
        part = "\n".join(lines[start : i + 1])
        if i - start + 1 >= most_lines or len(part) >= most_chars or i == len(lines) - 1:
            end = i
            for k in range(i, start - 1, -1):
                x = lines[k].strip(" ")
                if x == "" or x.startswith(("//", "#", "/*", "*")) or x.endswith((";", "}")):
                    end = k
                    break
            ends.append(end)
            start = end + 1
    ends = list(dict.fromkeys([*ends, len(lines) - 1]))
    out, b = [], 0
    for e in ends:
        content = "\n".join(lines[b : e + 1])
        if content.strip():
            out.append((b + 1, e + 1, content))
        b = e + 1
    return out


def code(seed, n):
    r = random.Random(seed)
    return "\n".join(r.choice(["", "x = 1;", "// note", "if (a) {", "}", "call(b", ")", "plain words here", "  "]) for _ in range(n))


def test_lines(spark):
    texts = [code(i, n) for i, n in enumerate([1, 2, 9, 40, 80])] + ["", "\n\n", "one\ntwo\nthree\nfour\nfive\nsix"]
    rows = K.chunks(docs_of(spark, [*texts, None]), K.line_ends(F.col("text"), 7, 60)).collect()
    got = spans(rows)
    assert all(got.get(i, []) == plain_lines(t, 7, 60) for i, t in enumerate(texts)) and len(texts) not in got


def plain_balanced(text, least_lines, least_chars, most_chars, most_lines, far):
    lines, out, start, depth = text.split("\n"), [], 0, 0
    for i, x in enumerate(lines):
        depth += sum(x.count(c) for c in "{([") - sum(x.count(c) for c in "})]")
        n, size = i - start + 1, len("\n".join(lines[start : i + 1]))
        if depth == 0 and n >= least_lines and size >= least_chars or size >= most_chars or n >= most_lines or i == len(lines) - 1 or abs(depth) > far:
            content = "\n".join(lines[start : i + 1])
            if content.strip():
                out.append((start + 1, i + 1, content))
            start, depth = i + 1, 0
    return out


def test_brackets(spark):
    texts = [code(i, n) for i, n in enumerate([1, 5, 30, 90])]
    rows = K.chunks(docs_of(spark, texts), K.balanced_ends(F.col("text"), [K.BRACKETS], 3, 10, 90, 12, 2)).collect()
    assert [spans(rows)[i] for i in range(len(texts))] == [plain_balanced(t, 3, 10, 90, 12, 2) for t in texts]


def test_markdown_and_xml(spark):
    text = "intro\n# one\na\n```\n# code\n```\n## two\nb"
    got = spans(K.chunks(docs_of(spark, [text]), K.markdown_ends(F.col("text"))).collect())[0]
    assert [(a, b) for a, b, _ in got] == [(1, 1), (2, 6), (7, 8)]
    tall = "\n".join(f"w{i}" if i % 10 else "" for i in range(1, 60))
    got = spans(K.chunks(docs_of(spark, [tall]), K.markdown_ends(F.col("text"), most_lines=25)).collect())[0]
    assert "\n".join(c for _, _, c in got) == tall and got[0][1] == 20
    xml = "<a>\n<b>" + "x" * 220 + "</b>\n</a>\n<c>\n</c>"
    assert [(a, b) for a, b, _ in spans(K.chunks(docs_of(spark, [xml]), K.xml_ends(F.col("text"))).collect())[0]] == [(1, 3), (4, 5)]


def test_by_language_and_windows(spark):
    df = docs_of(spark, ["# a\nb", "f(x);\n}", "<a/>"]).withColumn("l", F.element_at(F.array(F.lit("markdown"), F.lit("java"), F.lit("xml")), (F.col("doc_id") + 1).cast("int")))
    assert {r["strategy"] for r in K.chunk_by_language(df, "l").collect()} == {"markdown", "bracket", "xml"}
    assert docs_of(spark, ["abcdefg"]).select(K.char_windows(F.col("text"), 3, 1).alias("w")).first()["w"] == ["abc", "cde", "efg", "g"]


def test_post_processing(spark):
    rows = spark.createDataFrame([(1, 0, 1, 1, "tiny"), (1, 1, 2, 2, "x" * 150), (1, 2, 3, 3, "abc"), (1, 3, 4, 4, "some normal text"), (1, 4, 5, 5, "zz"), (2, 0, 1, 1, "small")], "doc_id long, chunk int, start_line int, end_line int, content string")
    kept = spans(K.filter_small(rows).collect())
    assert kept == {1: [(1, 3, "tiny\n" + "x" * 150 + "\nabc"), (4, 4, "some normal text")]}
    last = spans(K.rebalance_last(rows).collect())
    assert last[1][-1] == (4, 5, "some normal text\nzz") and last[2] == [(1, 1, "small")]
    lap = {r["chunk"]: r["overlap"] for r in K.with_overlap(rows, 1).where("doc_id = 1").collect()}
    assert lap[0] is None and lap[1] == "tiny"
    alike = spark.createDataFrame([(1, 0, 1, 1, "alpha beta"), (1, 1, 2, 2, "beta alpha"), (1, 2, 3, 3, "other words")], rows.schema)
    merged = spans(K.merge_neighbours(alike, T.keyword_similarity).collect())
    assert merged[1] == [(1, 2, "alpha beta\n\nbeta alpha"), (3, 3, "other words")] or len(merged[1]) == 2
    assert K.dedup(alike.withColumn("content", F.lit("same")), F.md5("content")).count() == 1
    assert K.similar_neighbours(alike).count() == 2


def test_embedded_code(spark):
    html = "<p>a</p><script type=\"text/typescript\">let s = '</p>';</script><style>b{}</style><script>x</script>"
    got = K.embedded(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert sorted((r["kind"], r["block"], r["language"], r["code"]) for r in got) == [("script", 0, "typescript", "let s = '</p>';"), ("script", 1, "javascript", "x"), ("style", 0, "css", "b{}")]


def test_sets_of_words_are_made_once_a_chunk(spark):
    """Joining by sets gives what joining by the score of texts gives, and the plan makes
    the words of a chunk in one place."""
    r = random.Random(6)
    some = ["alpha", "beta", "gamma", "delta", "12", "the", "omega-x", "Alpha"]
    rows = [(d, k, 3 * k + 1 + 60 * (r.random() < 0.1), 3 * k + 3, "\n".join(" ".join(r.choice(some) for _ in range(r.randint(0, 6))) for _ in range(3))) for d in range(30) for k in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "doc_id int, chunk int, start_line int, end_line int, content string")
    for least in (0.75, 0.4):
        want = sorted(map(tuple, K.merge_neighbours(df, T.keyword_similarity, least).collect()))
        found = K.merge_neighbours(df, least=least, words=T.keywords)
        assert sorted(map(tuple, found.collect())) == want and found.columns == df.columns
        assert 30 < len(want) < len(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(lower(") == 1, plan
