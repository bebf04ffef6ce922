"""Code to graph: definitions, imports and calls found line by line with patterns.

No parser is at hand, so patterns of common languages stand in for one; lines are dealt
out by ``posexplode`` and everything stays in Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import lines_of

# fixed values: kinds of entities and the pattern whose first group is the name
PATTERNS = {
    "class": r"^\s*(?:export\s+|public\s+|abstract\s+|final\s+)*(?:class|interface|struct)\s+([A-Za-z_]\w*)",
    "function": r"^\s*(?:export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+)*(?:function|def|func|fn)\s+([A-Za-z_]\w*)",
    "import": r"^\s*(?:import\s+(?:[\w{}*,\s]+\s+from\s+)?|from\s+|#include\s*|require\s*\(\s*|use\s+)[\"'<]?([\w./:@-]+)",
    "variable": r"^\s*(?:const|let|var)\s+([A-Za-z_]\w*)",
}
# fixed values: names before a bracket that are no calls
NO_CALLS = ["if", "for", "while", "switch", "catch", "return", "function", "def", "class", "print"]
# fixed values: spellings of ends of relationships, in order of preference
SOURCES, TARGETS = ["source", "sourceId", "fromNodeId", "src"], ["target", "targetId", "toNodeId", "dst"]


def lines(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    return files.where(F.col(text_col).isNotNull()).select(F.col(path_col).alias("path"), F.posexplode(lines_of(F.col(text_col))).alias("line", "code")).withColumn("line", F.col("line") + 1)


def entities(files: DataFrame, **columns) -> DataFrame:
    """``path, line, type, name, indent`` of every definition and import."""
    found = F.array(*[F.struct(F.lit(k).alias("type"), F.regexp_extract("code", p, 1).alias("name")) for k, p in PATTERNS.items()])
    rows = lines(files, **columns).select("path", "line", F.length(F.regexp_extract("code", r"^(\s*)", 1)).alias("indent"), F.explode(found).alias("e"))
    return rows.where("e.name <> ''").select("path", "line", "e.type", "e.name", "indent")


def with_owner(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds the definition that each line stands in: the last one before it, by a window
    over the lines of a file (no join of lines with definitions)."""
    both = rows.withColumn("_own", F.lit(None).cast("string")).unionByName(owners.select("path", "line", F.col("name").alias("_own")), allowMissingColumns=True)
    order = Window.partitionBy("path").orderBy("line", F.col("_own").isNotNull())
    before = F.last("_own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("owner", before).where("_own is null").drop("_own")


def calls(files: DataFrame, **columns) -> DataFrame:
    """``path, caller, callee, line``: names before a bracket, inside a function."""
    names = F.regexp_extract_all(F.col("code"), F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))
    used = lines(files, **columns).where(~F.col("code").rlike(PATTERNS["function"])).select("path", "line", F.explode(names).alias("callee"))
    used = used.where(~F.col("callee").isin(NO_CALLS))
    owned = with_owner(used, entities(files, **columns).where("type = 'function'"))
    return owned.where("owner is not null").select("path", F.col("owner").alias("caller"), "callee", "line")


def inheritance(files: DataFrame, **columns) -> DataFrame:
    """``path, child, parent, type``: EXTENDS and IMPLEMENTS, from child to parent."""
    code = lines(files, **columns)
    name = F.regexp_extract("code", PATTERNS["class"], 1)
    both = lambda kind, word: code.select("path", name.alias("child"), F.explode(F.split(F.regexp_extract("code", rf"\b{word}\s+([\w.]+(?:\s*,\s*[\w.]+)*)", 1), r"\s*,\s*")).alias("parent"), F.lit(kind).alias("type"))
    plain = F.regexp_extract("parent", r"^\s*([\w.]+)", 1)
    return both("INHERITS", "extends").unionByName(both("IMPLEMENTS", "implements")).withColumn("parent", plain).where("child <> '' and parent <> ''")


def to_graph(files: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, type, name`` and edges ``src, dst, type``: files contain definitions,
    import modules, functions call the functions of their file or any other, and classes
    inherit from or implement the classes of any file."""
    found = entities(files, **columns)
    file_id = F.concat(F.lit("file:"), F.col("path"))
    own_id = F.concat_ws(":", F.lit("symbol"), "name", "type", "path", F.col("line").cast("string"))
    module_id = F.concat(F.lit("module:"), F.col("name"))
    path = F.col(columns.get("path_col", "path"))
    nodes = files.select(F.concat(F.lit("file:"), path).alias("id"), F.lit("File").alias("type"), path.alias("name"))
    nodes = nodes.unionByName(found.where("type <> 'import'").select(own_id.alias("id"), F.initcap("type").alias("type"), "name"))
    nodes = nodes.unionByName(found.where("type = 'import'").select(module_id.alias("id"), F.lit("Import").alias("type"), "name").distinct())
    edges = found.where("type <> 'import'").select(file_id.alias("src"), own_id.alias("dst"), F.lit("CONTAINS").alias("type"))
    edges = edges.unionByName(found.where("type = 'import'").select(file_id.alias("src"), module_id.alias("dst"), F.lit("IMPORTS").alias("type")).distinct())
    functions = found.where("type = 'function'").select("path", "name", own_id.alias("id"))
    called = calls(files, **columns).select("path", "caller", "callee").distinct()
    ends = called.join(functions.select("path", F.col("name").alias("caller"), F.col("id").alias("src")), ["path", "caller"]).join(functions.select(F.col("name").alias("callee"), F.col("id").alias("dst")), "callee")
    edges = edges.unionByName(ends.where("src <> dst").select("src", "dst", F.lit("CALLS").alias("type")).distinct())
    classes = found.where("type = 'class'").select("path", "name", own_id.alias("id"))
    kin = inheritance(files, **columns).distinct().join(classes.select("path", F.col("name").alias("child"), F.col("id").alias("src")), ["path", "child"])
    kin = kin.join(classes.select(F.col("name").alias("parent"), F.col("id").alias("dst")), "parent")
    return nodes, edges.unionByName(kin.where("src <> dst").select("src", "dst", "type").distinct())


def ends_of(properties: Column) -> tuple[Column, Column]:
    """Source and target from a map of properties, whichever spelling is there."""
    first = lambda names: F.coalesce(*[F.try_element_at(properties, F.lit(n)) for n in names])
    return first(SOURCES), first(TARGETS)
