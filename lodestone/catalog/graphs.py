"""Graph queries over a property graph that the tables hold.

Nodes are nations, regions, suppliers, customers and parts; LOCATED_IN leads from
customers and suppliers to nations and from nations to regions, IMPORTS IMPORTS
and CALLS from every part to parts by fixed rules modulo the number of parts, so that the
graph grows with the tables and has cycles of several lengths.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .base import Catalog

C = Catalog()
query = C.query
NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, 'Region' AS type, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation
UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name FROM customer UNION ALL SELECT 'p' || p_partkey, 'Part', p_name FROM part)"""
EDGES = """edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'LOCATED_IN' AS type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN' FROM supplier
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LOCATED_IN' FROM customer UNION ALL SELECT 'p' || p_partkey, 'p' || (p_partkey * 7 + 3) % (SELECT count(*) FROM part), 'IMPORTS' FROM part
UNION ALL SELECT 'p' || p_partkey, 'p' || (p_partkey * 3 + 1) % (SELECT count(*) FROM part), 'CALLS' FROM part)"""
BOTH = f"{NODES}, {EDGES}"


def nodes_of(t):
    node = lambda name, letter, key, kind, label: t(name).select(F.concat(F.lit(letter), key).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("name"))
    out = node("region", "r", "r_regionkey", "Region", "r_name")
    for x in (("nation", "n", "n_nationkey", "Nation", "n_name"), ("supplier", "s", "s_suppkey", "Supplier", "s_name"), ("customer", "c", "c_custkey", "Customer", "c_name"), ("part", "p", "p_partkey", "Part", "p_name")):
        out = out.unionByName(node(*x))
    return out


def edges_of(t):
    edge = lambda df, a, src, b, dst, kind: df.select(F.concat(F.lit(a), src).alias("src"), F.concat(F.lit(b), dst).alias("dst"), F.lit(kind).alias("type"))
    part = t("part")
    key, n = F.col("p_partkey"), part.count()
    return (
        edge(t("nation"), "n", "n_nationkey", "r", "n_regionkey", "LOCATED_IN")
        .unionByName(edge(t("supplier"), "s", "s_suppkey", "n", "s_nationkey", "LOCATED_IN"))
        .unionByName(edge(t("customer"), "c", "c_custkey", "n", "c_nationkey", "LOCATED_IN"))
        .unionByName(edge(part, "p", key, "p", (key * 7 + 3) % n, "IMPORTS"))
        .unionByName(edge(part, "p", key, "p", (key * 3 + 1) % n, "CALLS"))
    )


def start_of(t, *ids):
    return t("region").sparkSession.createDataFrame([(i,) for i in ids], "id string")


@query(f"WITH {BOTH} SELECT n.id, n.type, n.name, e.type AS edge_type FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src IN ('n1', 's1', 'p1')")
def neighbours(t):
    return G.neighbours(edges_of(t), nodes_of(t), ["n1", "s1", "p1"]).select("id", "type", "name", "edge_type")


@query(f"WITH {BOTH} SELECT n.id, n.name FROM edges e JOIN nodes n ON n.id = e.src WHERE e.dst = 'r1' AND e.type = 'LOCATED_IN' ORDER BY n.id LIMIT 100")
def structure_children(t):
    return G.neighbours(edges_of(t), nodes_of(t), ["r1"], ["LOCATED_IN"], "in").orderBy("id").limit(100).select("id", "name")


@query(f"WITH {EDGES} SELECT DISTINCT c.dst AS id FROM edges a JOIN edges b ON b.src = a.dst JOIN edges c ON c.src = b.dst WHERE a.src IN ('p5', 'p6') AND a.type = 'IMPORTS' AND b.type = 'IMPORTS' AND c.type = 'IMPORTS'")
def traverse_exact(t):
    return G.exact_steps(edges_of(t), start_of(t, "p5", "p6"), 3, ["IMPORTS"])


def _reach(start: str, steps: int, cond: str, back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"""WITH RECURSIVE {EDGES}, w(id, depth) AS (SELECT '{start}', 0 UNION SELECT e.{b}, w.depth + 1 FROM w JOIN edges e ON e.{a} = w.id WHERE w.depth < {steps} AND {cond})
SELECT id, min(depth)::INTEGER AS depth FROM w GROUP BY 1 HAVING min(depth) > 0"""


@query(_reach("p5", 3, "type IN ('IMPORTS', 'CALLS')"))
def dependency_analysis(t):
    return G.up_to(edges_of(t), start_of(t, "p5"), 3, ["IMPORTS", "CALLS"])


@query(_reach("p7", 3, "type = 'CALLS'"))
def call_graph(t):
    return G.up_to(edges_of(t), start_of(t, "p7"), 3, G.FOCUS["functions"])


@query(_reach("r2", 2, "type = 'LOCATED_IN'", back=True))
def impact_reverse(t):
    return G.up_to(edges_of(t), start_of(t, "r2"), 2, ["LOCATED_IN"], "in")


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w(id, depth) AS (SELECT 's1', 0 UNION SELECT u.dst, w.depth + 1 FROM w JOIN u ON u.src = w.id WHERE w.depth < 2)
SELECT id, min(depth)::INTEGER AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")
def bfs_both_ways(t):
    return G.up_to(edges_of(t), start_of(t, "s1"), 2, None, "both")


PATHS = f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('IMPORTS', 'CALLS')),
p(path, here) AS (SELECT ['p5', dst], dst FROM e WHERE src = 'p5' UNION ALL SELECT list_append(path, e.dst), e.dst FROM p JOIN e ON e.src = p.here WHERE len(path) <= 4 AND p.here <> 'p115' AND NOT list_contains(path, e.dst)),
f AS (SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INTEGER AS steps FROM p WHERE here = 'p115')"""


@query(PATHS + " SELECT * FROM f")
def all_paths(t):
    found = G.paths(edges_of(t), "p5", "p115", 4, ["IMPORTS", "CALLS"])
    return found.select(F.array_join("path", ">").alias("path"), "steps")


@query(PATHS + " SELECT * FROM f ORDER BY steps, path LIMIT 1")
def shortest_path(t):
    return G.shortest_path(edges_of(t), "p5", "p115", 4, ["IMPORTS", "CALLS"]).select(F.array_join("path", ">").alias("path"), "steps")


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'IMPORTS' AND src <> dst), w(id, here, n) AS (SELECT src, dst, 1 FROM e UNION SELECT w.id, e.dst, n + 1 FROM w JOIN e ON e.src = w.here WHERE n < 6 AND w.here <> w.id)
SELECT id, min(n)::INTEGER AS length FROM w WHERE id = here AND n > 1 GROUP BY 1""")
def circular_dependencies(t):
    return G.cycles(edges_of(t), ["IMPORTS"], 6)


@query(f"""WITH RECURSIVE {BOTH}, u AS MATERIALIZED (SELECT src, dst FROM edges WHERE type <> 'LOCATED_IN' UNION SELECT dst, src FROM edges WHERE type <> 'LOCATED_IN'),
w(id, component) USING KEY (id) AS (SELECT id, id FROM nodes WHERE type = 'Part'
UNION SELECT u.dst, min(w.component) FROM w JOIN u ON u.src = w.id JOIN recurring.w AS o ON o.id = u.dst WHERE w.component < o.component GROUP BY 1)
SELECT id, component FROM w""")
def connected_components(t):
    e = edges_of(t).where("type <> 'LOCATED_IN'")
    return G.components(e, nodes_of(t).where("type = 'Part'").select("id").unionByName(e.select(F.col("dst").alias("id"))).distinct()).join(nodes_of(t).where("type = 'Part'").select("id"), "id", "left_semi")


@query(f"WITH {EDGES} SELECT id, count(*)::BIGINT AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_connected(t):
    return G.degrees(edges_of(t)).orderBy(F.desc("degree"), "id").limit(3)


@query(f"""WITH {BOTH}, n AS (SELECT sum((type = 'Part')::INT)::BIGINT AS functions, sum((type = 'Supplier')::INT)::BIGINT AS classes, count(*)::BIGINT AS n_nodes FROM nodes), e AS (SELECT sum((type = 'IMPORTS')::INT)::BIGINT AS imports, count(*)::BIGINT AS n_edges FROM edges),
x AS (SELECT *, least((2 * functions + 3 * classes + imports) / 10.0, 100.0)::DOUBLE AS complexity FROM n, e) SELECT *, greatest(100 - complexity - 0.5 * imports, 0.0)::DOUBLE AS maintainability, n_edges / greatest(n_nodes, 1)::DOUBLE AS average_degree FROM x""")
def graph_stats(t):
    return G.stats(edges_of(t), nodes_of(t), {"function": "Part", "class": "Supplier", "import": "IMPORTS"})


@query(f"WITH {NODES} SELECT type, count(*)::BIGINT AS n FROM nodes GROUP BY 1")
def project_overview(t):
    return nodes_of(t).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT type, count(*)::BIGINT AS n FROM edges GROUP BY 1")
def edge_type_counts(t):
    return edges_of(t).groupBy("type").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT n_nationkey, n_nationkey % 6 AS files, n_nationkey % 4 AS parts FROM nation), s AS (SELECT *, least((2 * files + parts) / 10.0, 10.0)::DOUBLE AS s FROM x)
SELECT n_nationkey, s AS score, CASE WHEN s > 7 THEN 'critical' WHEN s > 5 THEN 'high' WHEN s > 3 THEN 'medium' ELSE 'low' END AS risk FROM s""")
def impact_risk(t):
    score, risk = G.impact(F.col("n_nationkey") % 6, F.col("n_nationkey") % 4)
    return t("nation").select("n_nationkey", score.cast("double").alias("score"), risk.alias("risk"))


@query(f"WITH {BOTH} SELECT e.src, e.dst, e.type, 'dst' AS missing FROM edges e WHERE e.dst NOT IN (SELECT id FROM nodes) UNION ALL SELECT e.src, e.dst, e.type, 'src' FROM edges e WHERE e.src NOT IN (SELECT id FROM nodes)")
def referential_integrity(t):
    return G.dangling(edges_of(t), nodes_of(t))


@query(f"WITH {EDGES} SELECT src, dst, type FROM edges WHERE src NOT IN ('n1', 'n2', 'p1') AND dst NOT IN ('n1', 'n2', 'p1')")
def delete_nodes(t):
    return G.delete_nodes(edges_of(t), nodes_of(t), start_of(t, "n1", "n2", "p1"))[1]


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS file, l_linenumber::BIGINT AS s, l_linenumber + l_quantity::BIGINT AS e FROM lineitem)
SELECT a.id AS outer, b.id AS inner, greatest(0.0, 1 - (b.s - a.s) / 100.0)::DOUBLE AS strength FROM c a JOIN c b ON a.file = b.file AND a.s <= b.s AND a.e >= b.e AND a.id <> b.id""".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'))
def containment_edges(t):
    line = F.col("l_linenumber").cast("long")
    chunks = t("lineitem").select((F.col("l_orderkey") * 10 + line).alias("id"), F.col("l_orderkey").alias("file"), line.alias("start"), (line + F.col("l_quantity").cast("long")).alias("end"))
    return G.containment(chunks)


@query("""SELECT conv_id, a AS src, b AS dst FROM (SELECT conv_id, turn AS a, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL""")
def follows_edges(t):
    from pyspark.sql import Window

    nxt = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").select("conv_id", F.col("turn").alias("src"), nxt.alias("dst")).where("dst is not null")


def _ranks(rounds: int = 20) -> str:
    step = "r{0} AS MATERIALIZED (SELECT n.id, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + l.lost / c.n) AS rank FROM n LEFT JOIN (SELECT dst, sum(rank / degree) AS got FROM r{1} JOIN h ON r{1}.id = h.src GROUP BY 1) g ON g.dst = n.id, c, (SELECT coalesce(sum(rank), 0) AS lost FROM r{1} WHERE id NOT IN (SELECT src FROM h)) l)"
    return ", ".join(step.format(i, i - 1) for i in range(1, rounds + 1))


@query(f"""WITH {EDGES}, e AS MATERIALIZED (SELECT src, dst FROM edges WHERE type = 'IMPORTS'), n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), c AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM n),
h AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM e), r0 AS MATERIALIZED (SELECT id, 1 / n AS rank FROM n, c), {_ranks()} SELECT id, round(rank, 10) AS rank FROM r20""")
def page_rank(t):
    e = edges_of(t).where("type = 'IMPORTS'")
    n = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return G.page_rank(e, n).select("id", F.round("rank", 10).alias("rank"))


def _labels(rounds: int = 10) -> str:
    vote = "SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS k FROM h JOIN l{0} ON h.dst = l{0}.id GROUP BY 1, 2"
    step = "l{0} AS MATERIALIZED (SELECT n.id, coalesce(b.label, l{1}.label) AS label FROM n JOIN l{1} USING (id) LEFT JOIN (" + vote.replace("{0}", "{1}") + ") b ON b.src = n.id AND b.k = 1)"
    return ", ".join(step.format(i, i - 1) for i in range(1, rounds + 1))


@query(f"""WITH {EDGES}, e AS MATERIALIZED (SELECT src, dst FROM edges WHERE type = 'CALLS'), n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), h AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
l0 AS MATERIALIZED (SELECT id, id AS label FROM n), {_labels()} SELECT id, label AS community FROM l10 WHERE label IN (SELECT label FROM l10 GROUP BY 1 HAVING count(*) >= 2)""")
def communities(t):
    e = edges_of(t).where("type = 'CALLS'")
    n = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return G.communities(e, n)


@query(f"""WITH RECURSIVE {BOTH}, w(id, depth) AS (SELECT 'p5', 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.id WHERE w.depth < 2 AND type = 'IMPORTS')
SELECT 'schema' AS kind, type AS found, count(*)::BIGINT AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'keyword', id, 1 FROM (SELECT id FROM nodes WHERE contains(name, '7') ORDER BY id LIMIT 10) UNION ALL SELECT 'exact', id, 1 FROM nodes WHERE id = 's3'
UNION ALL SELECT 'neighbor', dst, 1 FROM edges WHERE src = 'p5' AND type = 'IMPORTS' UNION ALL SELECT 'path', id, min(depth) FROM w GROUP BY id HAVING min(depth) > 0""")
def search_dispatch(t):
    """All five kinds of search by one entry."""
    edges, nodes, one = edges_of(t), nodes_of(t), F.lit(1).cast("long")
    row = lambda kind, df, found, n: df.select(F.lit(kind).alias("kind"), F.col(found).alias("found"), n.cast("long").alias("n"))
    out = row("schema", G.search(edges, nodes, "schema", ""), "type", F.col("n"))
    out = out.unionByName(row("keyword", G.search(edges, nodes, "keyword", "7"), "id", one)).unionByName(row("exact", G.search(edges, nodes, "exact", "s3"), "id", one))
    out = out.unionByName(row("neighbor", G.search(edges, nodes, "neighbor", "p5", types=["IMPORTS"]), "id", one))
    return out.unionByName(row("path", G.search(edges, nodes, "path", "p5", types=["IMPORTS"]), "id", F.col("depth")))
