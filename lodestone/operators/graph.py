"""Property graphs as two tables: nodes(id, type, name), edges(src, dst, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components as _components
from ..plans.lineage import cut

# fixed values: edge types that a focus looks at
FOCUS = {"dependencies": ["IMPORTS", "DEPENDS_ON", "CALLS"], "imports": ["IMPORTS"], "classes": ["CONTAINS", "INHERITS", "IMPLEMENTS"], "functions": ["CONTAINS", "CALLS"]}


def directed(edges: DataFrame, types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """Edges of some types, as they stand, reversed, or both ways."""
    df = edges.where(F.col("type").isin(types)) if types else edges
    df = df.select("src", "dst", "type")
    back = df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return df if direction == "out" else back if direction == "in" else df.unionByName(back)


def neighbours(edges: DataFrame, nodes: DataFrame, start: list, types: list[str] | None = None, direction: str = "out") -> DataFrame:
    hop = directed(edges, types, direction).where(F.col("src").isin(start)).select("src", F.col("dst").alias("id"), F.col("type").alias("edge_type"))
    return hop.join(nodes, "id")


def exact_steps(edges: DataFrame, start: DataFrame, steps: int, types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """Distinct ids after exactly ``steps`` hops; ``start`` has a column id."""
    hops = directed(edges, types, direction).select("src", "dst").distinct()
    at = start.select("id").distinct()
    for _ in range(steps):
        at = at.join(hops, at["id"] == hops["src"]).select(F.col("dst").alias("id")).distinct()
    return at


def up_to(edges: DataFrame, start: DataFrame, steps: int, types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """``id, depth``: least number of hops (1 and more) to every id within ``steps``. The
    starts themselves are left out. Every hop is cut off from the ones before it."""
    hops = directed(edges, types, direction).select("src", "dst").distinct()
    seen = start.select("id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, steps + 1):
        nxt = frontier.join(hops, frontier["id"] == hops["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = nxt.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        if depth < steps:
            frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def restricted(edges: DataFrame, nodes: DataFrame, edge_where: Column | None = None, node_where: Column | None = None) -> DataFrame:
    """Edges (any columns beside ``src, dst, type``) that meet a condition and lead to nodes
    that meet one: what each hop of a traversal with filters may use, so both conditions are
    applied once, below the first hop."""
    some = edges if edge_where is None else edges.where(edge_where)
    return some if node_where is None else some.join(nodes.where(node_where).select(F.col("id").alias("dst")), "dst", "left_semi")


def traverse(edges: DataFrame, nodes: DataFrame, start: DataFrame, steps: int = 3, types: list[str] | None = None, edge_where: Column | None = None, node_where: Column | None = None, limit: int = 10) -> DataFrame:
    """The nearest nodes within ``steps`` hops over edges of some types, every edge and every
    node on the way meeting its condition (properties are maps: ``properties['k']``); the
    columns of ``nodes`` and ``depth``, by depth and id."""
    found = up_to(restricted(edges, nodes, edge_where, node_where), start, steps, types)
    return found.join(nodes, "id").orderBy("depth", "id").limit(limit)


def paths(edges: DataFrame, source: object, target: object, longest: int, types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """``path, steps``: all simple paths of at most ``longest`` hops."""
    hops = directed(edges, types, direction).select("src", "dst").distinct()
    open_ = hops.where(F.col("src") == source).select(F.array("src", "dst").alias("path"))
    done = None
    for _ in range(longest):
        ended = open_.where(F.element_at("path", -1) == target)
        done = ended if done is None else done.unionByName(ended)
        going = open_.where(F.element_at("path", -1) != target).withColumn("at", F.element_at("path", -1))
        open_ = going.join(hops, going["at"] == hops["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return done.select("path", (F.size("path") - 1).alias("steps"))


def shortest_path(edges: DataFrame, source: object, target: object, longest: int = 10, types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """The shortest path, of equal ones the first in order of ids: a breadth-first search
    that keeps one least path to every id."""
    hops = directed(edges, types, direction).select("src", "dst").distinct()
    seen = hops.sparkSession.range(1).select(F.lit(source).alias("id"), F.array(F.lit(source)).alias("path"))
    frontier = seen
    for _ in range(longest):
        nxt = frontier.join(hops, frontier["id"] == hops["src"]).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut(nxt.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti").select("id", "path"))
        seen = seen.unionByName(frontier)
        if frontier.where(F.col("id") == target).limit(1).count() or frontier.isEmpty():
            break
    return seen.where(F.col("id") == target).select("path", (F.size("path") - 1).alias("steps"))


def cycles(edges: DataFrame, types: list[str], longest: int) -> DataFrame:
    """``id, length``: ids on a cycle of 2 to ``longest`` hops, with their shortest.

    Ids without an edge in or without one out are on no cycle; they go first, round by
    round, for as many rounds as a cycle may have hops. Of a shortest cycle one half leads
    to an id and the other back from it, so walks of half the length are enough: least
    distances of pairs meet the same pairs the other way round."""
    hops = cut(directed(edges, types).select("src", "dst").where("src <> dst").distinct())
    left = hops.count()
    for _ in range(longest):
        ends = lambda c, as_: hops.select(F.col(c).alias(as_)).distinct()
        hops = cut(hops.join(ends("dst", "src"), "src", "left_semi").join(ends("src", "dst"), "dst", "left_semi").select("src", "dst"))
        before, left = left, hops.count()
        if left == before:
            break
    seen = hops.select(F.col("src").alias("id"), F.col("dst").alias("at"), F.lit(1).alias("n"))
    frontier = seen
    for n in range(2, (longest + 1) // 2 + 1):
        nxt = frontier.join(hops, frontier["at"] == hops["src"]).select("id", F.col("dst").alias("at")).where("id <> at").distinct()
        frontier = cut(nxt.join(seen, ["id", "at"], "left_anti").withColumn("n", F.lit(n)))
        seen = seen.unionByName(frontier)
    back = seen.select(F.col("at").alias("id"), F.col("id").alias("at"), F.col("n").alias("m"))
    return seen.join(back, ["id", "at"]).groupBy("id").agg(F.min(F.col("n") + F.col("m")).alias("length")).where(F.col("length") <= longest)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, component`` of every node; a node without edges is its own."""
    linked = _components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), cut)
    return nodes.select("id").join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def page_rank(edges: DataFrame, nodes: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """``id, rank``; ids without edges out give their rank to all."""
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    hops = cut(edges.select("src", "dst").join(out, "src"))
    rank = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    sinks = cut(nodes.select("id").join(out, nodes["id"] == out["src"], "left_anti"))
    for i in range(rounds):
        lost = rank.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = rank.join(hops, rank["id"] == hops["src"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        rank = nodes.select("id").join(given, nodes["id"] == given["dst"], "left").join(F.broadcast(lost))  # a single row
        rank = rank.select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if i % 4 == 3:
            rank = cut(rank)
    return rank


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 10, least: int = 2) -> DataFrame:
    """``id, community`` by label propagation: the most frequent label of the neighbours,
    of equally frequent ones the smallest. Communities under ``least`` members go."""
    hops = cut(directed(edges, None, "both").select("src", "dst").distinct())
    label = nodes.select("id", F.col("id").alias("label"))
    for i in range(rounds):
        votes = hops.join(label, hops["dst"] == label["id"]).groupBy("src", "label").count()
        best = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("best"))
        label = label.join(best, label["id"] == best["src"], "left").select("id", F.coalesce("best", "label").alias("label"))
        if i % 3 == 2:
            label = cut(label)
    label = cut(label)
    large = label.groupBy("label").count().where(F.col("count") >= least).select("label")
    return label.join(large, "label", "left_semi").select("id", F.col("label").alias("community"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def stats(edges: DataFrame, nodes: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Complexity and maintainability of a graph from how many nodes play which role."""
    of = lambda role: F.sum((F.col("type") == roles[role]).cast("int"))
    n = nodes.agg(of("function").alias("functions"), of("class").alias("classes"), F.count("*").alias("n_nodes"))
    e = edges.agg(F.sum((F.col("type") == roles["import"]).cast("int")).alias("imports"), F.count("*").alias("n_edges"))
    df = n.join(F.broadcast(e))  # single rows
    df = df.withColumn("complexity", F.least((2 * F.col("functions") + 3 * F.col("classes") + F.col("imports")) / 10, F.lit(100.0)))
    df = df.withColumn("maintainability", F.greatest(100 - F.col("complexity") - 0.5 * F.col("imports"), F.lit(0.0)))
    return df.withColumn("average_degree", F.col("n_edges") / F.greatest(F.col("n_nodes"), F.lit(1)))


def impact(files: Column, parts: Column) -> tuple[Column, Column]:
    """Score and risk of what a change reaches."""
    score = F.least((2 * files + parts) / 10, F.lit(10.0))
    return score, F.when(score > 7, "critical").when(score > 5, "high").when(score > 3, "medium").otherwise("low")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that no node has, and which end that is."""
    ids = nodes.select(F.col("id").alias("end"))
    missing = [edges.join(ids, edges[end] == ids["end"], "left_anti").withColumn("missing", F.lit(end)) for end in ("src", "dst")]
    return missing[0].unionByName(missing[1])


def delete_nodes(edges: DataFrame, nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that are left when ``gone`` (id) and all their edges go."""
    ends = gone.select(F.col("id").alias("end")).distinct()
    left = edges.join(ends, edges["src"] == ends["end"], "left_anti").join(ends, edges["dst"] == ends["end"], "left_anti")
    return nodes.join(gone.select("id").distinct(), "id", "left_anti"), left


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that are left when those named by ``src, dst, type`` go."""
    return edges.join(gone.select("src", "dst", "type").distinct(), ["src", "dst", "type"], "left_anti")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the type and name of both ends; an end that no node has stays null."""
    end = lambda at: nodes.select(F.col("id").alias(at), F.col("type").alias(f"{at}_type"), F.col("name").alias(f"{at}_name"))
    return edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")


# fixed values: limits and the words of an insight
INSIGHTS = [
    ("average_degree > 5", "The codebase has a high connectivity, which may indicate tight coupling between components."),
    ("external > 0.5 * files", "The project has a high ratio of external dependencies to project files, which may increase maintenance complexity."),
    ("components < 5", "The project has few connected components, which may indicate a monolithic architecture."),
]


def insights(measures: DataFrame) -> DataFrame:
    """``insight`` rows of a graph's measures (average_degree, external, files, components)."""
    told = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(text)) for test, text in INSIGHTS]))
    return measures.select(F.explode(told).alias("insight"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same keys; missing columns become null."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def containment(chunks: DataFrame) -> DataFrame:
    """``outer, inner, strength`` of chunks (id, file, start, end) of which one lies in
    another; near starts are stronger."""
    a, b = chunks.alias("a"), chunks.alias("b")
    inside = (F.col("a.file") == F.col("b.file")) & (F.col("a.start") <= F.col("b.start")) & (F.col("a.end") >= F.col("b.end")) & (F.col("a.id") != F.col("b.id"))
    return a.join(b, inside).select(F.col("a.id").alias("outer"), F.col("b.id").alias("inner"), F.greatest(F.lit(0.0), 1 - (F.col("b.start") - F.col("a.start")) / 100).alias("strength"))


def search(edges: DataFrame, nodes: DataFrame, kind: str, text: str, limit: int = 10, depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """One entry for all searches: keyword, exact, neighbor, path ("a,b" or one id), schema."""
    if kind == "keyword":
        return nodes.where(F.col("name").contains(text)).orderBy("id").limit(limit)
    if kind == "exact":
        return nodes.where(F.col("id") == text).limit(limit)
    if kind == "neighbor":
        return neighbours(edges, nodes, [text], types).orderBy("id").limit(limit)
    if kind == "schema":
        return nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy("type").limit(limit)
    if kind == "path":
        ends = text.split(",")
        if len(ends) == 2:
            return shortest_path(edges, ends[0].strip(), ends[1].strip(), depth, types)
        start = nodes.where(F.col("id") == text).select("id")
        return up_to(edges, start, depth, types).orderBy("depth", "id").limit(limit)
    raise ValueError(f"unknown search type {kind}")
