"""Definitions and chunks of code. The files are derived from orders: a customer's orders
are the methods of a class, their lines functions inside, in brackets for even customers
and by indentation for odd ones, so what has to be found follows from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages as L
from ..operators import boundaries as B
from ..operators import chunking as K
from ..operators import code_quality as Q
from ..operators import graph as G
from ..operators import overlaps as O
from ..operators import rebalance as R
from ..operators import structure as S
from .base import Catalog
from .graphs import BOTH, edges_of, nodes_of, start_of

C = Catalog()
query = C.query


def code_files(t):
    """``custkey, path, text``."""
    # orders and files are numbers until their text is made, so no text is dealt out; line
    # numbers repeat within an order, so its lines are numbered by their sizes
    more = (F.floor("l_quantity") % 4).cast("int").alias("more")
    lines = t("lineitem").where("l_orderkey is not null").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(F.struct(more, "l_linenumber"))).alias("lines"))
    joined = lines.select("o", F.col("lines.more").alias("lines")).join(t("orders").select(F.col("o_orderkey").alias("o"), "o_custkey"), "o")
    # the few numbers of a partition become many lines, so partitions are not joined by size
    joined = joined.repartition(int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    files = joined.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o", "lines"))).alias("orders"))
    even = F.col("o_custkey") % 2 == 0
    joint = lambda items, part: F.array_join(F.transform(items, part), "\n")
    # what follows a function's number, by the number of its steps (-3 to 3, or none known)
    steps = lambda more, call: "\n".join(call.format(k) for k in (range(1, more + 1) if more > 0 else range(1, more - 1, -1)))
    tail = lambda ends, unknown, more: F.coalesce(F.get(F.array(*map(F.lit, ends)), more + 3), F.lit(unknown))
    in_brackets = ["() {\n" + (steps(m, " " * 6 + "step({});") + "\n" if m else "") + "    }" for m in range(-3, 4)]
    by_indent = ["():\n" + steps(m + 1, " " * 12 + "step({})") for m in range(-3, 4)]
    bracket = lambda more, i: F.concat(F.lit("    function line"), (i + 1).cast("string"), tail(in_brackets, "() {\n\n    }", more))
    indented = lambda more, i: F.concat(F.lit("        def line_"), (i + 1).cast("string"), tail(by_indent, "():\n", more))
    braces = lambda x: F.concat(F.lit("  order"), x["o"].cast("string"), F.lit("(total) {\n"), joint(x["lines"], bracket), F.lit('\n    // no end: } {\n    say("}");\n  }'))
    colons = lambda x: F.concat(F.lit("    def order_"), x["o"].cast("string"), F.lit("(self):\n"), joint(x["lines"], indented), F.lit("\n"))
    files = files.withColumn("body", F.when(even, joint("orders", braces)).otherwise(joint("orders", colons)))
    key = F.col("o_custkey").cast("string")
    text = F.when(even, F.concat(F.lit('import { step } from "steps";\n\nexport class Customer'), key, F.lit(" {\n"), "body", F.lit("\n}"))).otherwise(F.concat(F.lit("from steps import step\n\nclass Customer"), key, F.lit(":\n"), "body"))
    return files.select(F.col("o_custkey").alias("custkey"), F.concat(F.lit("c"), key, F.when(even, ".ts").otherwise(".py")).alias("path"), text.alias("text"))


# where the parts of those files stand, by adding up their lines
SPANS = """l AS (SELECT o_custkey AS c, o_custkey % 2 = 0 AS even, l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity)::INT % 4, l_linenumber) AS n, floor(l_quantity)::INT % 4 AS more FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
h AS (SELECT *, 2 + more AS height FROM l),
i AS (SELECT *, coalesce(sum(height) OVER (PARTITION BY c, o ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM h),
m AS (SELECT c, even, o, sum(height) AS inside, sum(height) + CASE WHEN even THEN 4 ELSE 2 END AS height FROM h GROUP BY c, even, o),
p AS (SELECT *, 4 + coalesce(sum(height) OVER (PARTITION BY c ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM m),
k AS (SELECT c, even, sum(height) AS height FROM m GROUP BY c, even),
spans AS (SELECT c AS custkey, 'class' AS kind, 'Customer' || c AS name, 3 AS start_line, CASE WHEN even THEN 4 + height ELSE 2 + height END AS end_line, 0 AS level, NULL::BIGINT AS parent_line FROM k
UNION ALL SELECT c, CASE WHEN even THEN 'method' ELSE 'function' END, CASE WHEN even THEN 'order' || o ELSE 'order_' || o END, first, CASE WHEN even THEN first + inside + 3 ELSE first + inside END, 1, 3 FROM p
UNION ALL SELECT i.c, 'function', CASE WHEN i.even THEN 'line' || n ELSE 'line_' || n END, first + 1 + above, first + above + i.height, 2, first FROM i JOIN p ON p.c = i.c AND p.o = i.o)"""


@query(f"WITH {SPANS} SELECT custkey, kind, name, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, level::BIGINT AS level, parent_line::BIGINT AS parent_line FROM spans")
def code_definitions(t):
    long = [F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "level", "parent_line")]
    return S.definitions(code_files(t), keys=("custkey",)).select("custkey", "kind", "name", *long)


@query()
def structure_chunks(t):
    rows = S.structure_chunks(code_files(t), keys=("custkey",))
    return rows.select("custkey", "kind", "name", *[F.col(c).cast("long").alias(c) for c in ("chunk", "start_line", "end_line", "level")], F.md5("content").alias("digest"))


# calls of those files: every step is called by its line, and say by every even order
CALLS = """calls AS (SELECT i.c AS custkey, first + 1 + above + k AS line, 'step' AS name, first + 1 + above AS owner_line, CASE WHEN i.even THEN 'line' || n ELSE 'line_' || n END AS owner FROM i JOIN p ON p.c = i.c AND p.o = i.o, unnest(range(1, more + CASE WHEN i.even THEN 1 ELSE 2 END)) s(k)
UNION ALL SELECT c, first + inside + 2, 'say', first, 'order' || o FROM p WHERE even)"""


@query(f"WITH {SPANS}, {CALLS} SELECT custkey, line::BIGINT AS line, name, owner_line::BIGINT AS owner_line, owner FROM calls")
def code_calls(t):
    owned = S.owned_uses(code_files(t), keys=("custkey",))
    return owned.where("does = 'CALLS'").select("custkey", F.col("line").cast("long").alias("line"), "name", F.col("owner_line").cast("long").alias("owner_line"), F.col("owner_name").alias("owner"))


@query(f"""WITH {SPANS}, {CALLS}, e AS (SELECT DISTINCT custkey, line FROM calls), n AS (SELECT e.custkey, e.line, s.kind || ':' || s.name AS id, row_number() OVER (PARTITION BY e.custkey, e.line ORDER BY s.start_line) AS k FROM e JOIN spans s ON s.custkey = e.custkey AND abs(s.start_line - e.line) <= 10)
SELECT c.custkey, c.line::BIGINT AS line, c.name, CASE WHEN b.id IS NOT NULL THEN a.id END AS from_id, b.id AS to_id FROM calls c LEFT JOIN n a ON a.custkey = c.custkey AND a.line = c.line AND a.k = 1 LEFT JOIN n b ON b.custkey = c.custkey AND b.line = c.line AND b.k = 2""")
def edge_endpoints(t):
    """The first two definitions within ten lines of every call."""
    found = S.ended_uses(code_files(t), keys=("custkey",)).where("does = 'CALLS'")
    return found.select("custkey", F.col("line").cast("long").alias("line"), "name", "from_id", "to_id")


HOPS = """h AS (SELECT e.src, e.dst FROM edges e JOIN part q ON 'p' || q.p_partkey = e.dst WHERE e.type IN ('IMPORTS', 'CALLS') AND substr(e.src, 2)::BIGINT % 10 < 8 AND q.p_size >= 10)"""


@query(f"""WITH RECURSIVE {BOTH}, {HOPS}, r(id, depth) AS (SELECT id, 0 FROM nodes WHERE id IN ('p1', 'p2', 'p3') UNION SELECT h.dst, r.depth + 1 FROM r JOIN h ON h.src = r.id WHERE r.depth < 4)
SELECT id, min(depth)::INTEGER AS depth, q.p_size::VARCHAR AS size FROM r JOIN part q ON 'p' || q.p_partkey = r.id GROUP BY id, q.p_size HAVING min(depth) > 0 ORDER BY depth, id LIMIT 40""")
def filtered_traversal(t):
    """Parts within four hops over edges of weight below 8 and parts of size 10 and more."""
    sizes = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("properties"))
    nodes = nodes_of(t).join(sizes, "id", "left")
    edges = edges_of(t).withColumn("properties", F.create_map(F.lit("weight"), (F.substring("src", 2, 20).cast("long") % 10).cast("string")))
    found = G.traverse(edges, nodes, start_of(t, "p1", "p2", "p3"), 4, ["IMPORTS", "CALLS"], F.expr("cast(properties['weight'] as int) < 8"), F.expr("cast(properties['size'] as int) >= 10"), limit=40)
    return found.select("id", "depth", F.expr("properties['size']").alias("size"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(x: str, kind: str) -> str:
    return f"coalesce(regexp_matches(trim({x}), {_quoted('|'.join(L.LINE_KINDS[kind]))}), false)"


def _plain(text: str) -> str:
    for p in Q.ASIDE:
        text = f"regexp_replace({text}, {_quoted(p)}, ' ', 'g')"
    return text


NET = lambda x, a, b: f"(length(replace({x}, '{b}', '')) - length(replace({x}, '{a}', '')))"
STARTS = lambda x: f"({_kind(x, 'function')} OR {_kind(x, 'class')})"
DECLARES = lambda x: f"coalesce(regexp_matches(trim({x}), {_quoted(B.DECLARED)}), false)"
KNOWN = list(B.WEIGHTS)
WEIGHT_ROWS = ", ".join(f"({i}, '{k}', [{', '.join(map(str, B.WEIGHTS.get(k, B.COMMON)))}])" for i, k in enumerate([*KNOWN, "other"]))


@query(f"""WITH w(k, language, w) AS (VALUES {WEIGHT_ROWS}), l AS (SELECT doc_id, doc_id % {len(KNOWN) + 1} AS k, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
c AS (SELECT *, lag(x) OVER o AS a, lead(x) OVER o AS b, trim(translate(x, chr(9) || chr(13), '  ')) AS t, {_plain('x')} AS d FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
p AS (SELECT *, {_plain('t')} AS tp FROM c),
f AS (SELECT *, regexp_matches(t, {_quoted(B.ONLY_CLOSERS)}) OR ({NET('tp', '(', ')')} = 0 AND {NET('tp', '{', '}')} = 0 AND {NET('tp', '[', ']')} = 0 AND (length(tp) - length(replace(tp, '`', ''))) % 2 = 0) AS f1,
regexp_matches(t, {_quoted(B.FUNCTION_CLOSED)}) AS f2, regexp_matches(t, {_quoted(B.CLOSED)}) AS f3, {_kind('x', 'import')} OR regexp_matches(t, {_quoted(B.EXPORTED)}) AS f5,
t = '' AND a IS NOT NULL AND b IS NOT NULL AND ({STARTS('a')} OR {STARTS('b')} OR ({DECLARES('a')} AND {DECLARES('b')})) AS f6, {_kind('x', 'comment')} AS f7 FROM p)
SELECT doc_id, line, round(least(1.0, {' + '.join(f"CASE WHEN {name} THEN w[{i + 1}] * {B.SHARES[i]} ELSE 0.0 END" for i, name in enumerate(('f1', 'f2', 'f3', 'f3', 'f5', 'f6', 'f7')))}), 6)::DOUBLE AS score,
(sum({NET('d', '{', '}')}) OVER (PARTITION BY doc_id ORDER BY line))::BIGINT AS depth FROM f JOIN w USING (k)""")
def boundary_lines(t):
    """Every line of all documents, with the weights of one language after another."""
    names = F.array(*map(F.lit, [*KNOWN, "other"]))
    rows = B.boundary_lines(t("documents"), F.get(names, (F.col("doc_id") % (len(KNOWN) + 1)).cast("int")))
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), F.round("score", 6).alias("score"), F.col("depth").cast("long").alias("depth"))


@query()
def rebalanced_chunks(t):
    """Line chunks of all documents, cut and joined to a like size."""
    rows = K.chunks(t("documents"), K.line_ends(F.col("text"), 8, 600)).withColumns({"type": F.when(F.col("chunk") % 3 == 0, "code").otherwise("import"), "language": F.lit("text")})
    return R.rebalance(rows).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk", "start_line", "end_line")], F.md5("content").alias("digest"))


@query()
def chunk_overlaps(t):
    """Overlaps between the pieces that bracket chunks of the code files hand on."""
    files = code_files(t).withColumn("language", F.when(F.col("custkey") % 2 == 0, "typescript").otherwise("python"))
    found = O.text_overlaps(files, K.text_bracket_ends, keys=("custkey",))
    return found.select("custkey", F.col("chunk").cast("long").alias("chunk"), "strategy", F.md5("overlap").alias("digest"), F.round("quality", 6).alias("quality"))
