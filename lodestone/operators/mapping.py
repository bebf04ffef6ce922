"""From parsed rows and from raw results to nodes and edges, and checks of both.

Raw values are JSON texts. A text that is no JSON object, and one that is null, has no
keys: its row loses what would be read from it, as each function says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup

# fixed values: what kind of node an entity becomes; other entities become chunks
ENTITIES = ["function", "class", "method", "import", "variable", "interface", "type", "union", "enum"]
NODE_KINDS = {"function": "Function", "class": "Class", "variable": "Variable", "import": "Import", "interface": "Interface", "method": "Method", "type": "Property"}
# fixed values: of each relation the edge's type and the property that takes its own type
RELATIONS = {
    "call": ("CALLS", None), "data-flow": ("DATA_FLOWS_TO", "flowType"), "inheritance": ("INHERITS", "inheritanceType"), "implements": ("IMPLEMENTS", "implementsType"), "annotation": ("ANNOTATES", "annotationType"),
    "creation": ("CREATES", "creationType"), "dependency": ("DEPENDS_ON", "dependencyType"), "reference": ("REFERENCES", "referenceType"), "concurrency": ("SYNCHRONIZES_WITH", "concurrencyType"),
    "lifecycle": ("MANAGES_LIFECYCLE", "lifecycleType"), "semantic": ("OVERRIDES", "semanticType"), "control-flow": ("CONTROLS", "controlFlowType"),
}
# fixed values: relations whose ends are spelled fromNodeId and toNodeId, not source and target
BY_NODE_ID = ["call", "data-flow"]
# fixed values: spellings of a result's parts in order of preference, and what stands for none
UNKNOWN = "unknown"
NODE_KEYS = {"id": ["id", "_id", "vertex.id", "vertex._vid"], "type": ["type", "label", "tag", "vertex.tag", "vertex._tag"], "name": ["name", "label", "vertex.name", "vertex._tag"], "properties": ["properties", "props", "vertex.props", "vertex.properties"]}
EDGE_KEYS = {
    "id": ["id", "_id", "edge.id", "edge._edgeId"], "type": ["type", "edgeType", "name", "edge.type", "edge.name"], "src": ["source", "src", "from", "edge.src", "edge.from"], "dst": ["target", "dst", "to", "edge.dst", "edge.to"],
    "properties": ["properties", "props", "edge.props", "edge.properties"],
}
# fixed values: types of nodes and edges that a graph may hold
NODE_TYPES = "File Function Class Variable Import Interface Method Property Chunk Element Document Script Style Attribute Text".split()
EDGE_TYPES = """CONTAINS IMPORTS CALLS INHERITS IMPLEMENTS USES DEFINES DATA_FLOWS_TO PARAMETER_PASSES_TO RETURNS_TO CONTROLS HANDLES_EXCEPTION CALLBACKS AWAITS OVERRIDES OVERLOADS DELEGATES_TO OBSERVES CONFIGURES
INSTANTIATES INITIALIZES DESTROYS MANAGES_LIFECYCLE SYNCHRONIZES_WITH LOCKS COMMUNICATES_WITH RACES_WITH ANNOTATES DECORATES TAGS CREATES ALLOCATES DEPENDS_ON REFERENCES ACCESSES READS WRITES DECLARES USES_VARIABLE""".split()
# fixed values: properties that a node of a type must have, with what they must be, if anything
REQUIRED = {
    "File": {"name": None, "path": None, "language": None, "size": "count", "lastModified": "string", "projectId": None},
    "Function": {"name": None, "signature": None, "startLine": "count", "endLine": "count", "complexity": "count", "parentFileId": None},
    "Class": {"name": None, "methods": "list", "properties": "list", "parentFileId": None},
    "Variable": {"name": "text", "type": None, "scope": None},
    "Import": {"name": "text", "path": "text"},
}


def to_nodes(rows: DataFrame) -> DataFrame:
    """``id, type, name, path, line`` of the entities among parsed rows (``id, type, name,
    path, line, data``); rows of other types are no nodes."""
    return rows.where(F.col("type").isin(ENTITIES)).select("id", lookup(NODE_KINDS, F.col("type"), "Chunk").alias("type"), "name", "path", "line")


def to_edges(rows: DataFrame) -> DataFrame:
    """``id, type, src, dst, properties`` of the relations among parsed rows.

    ``data`` gives the ends and all properties; a relation's own type is a property of its
    own name, unless ``data`` has one of that name. Rows of unknown relations and rows
    without data go; an end that data does not name stays null (``edge_errors`` tells)."""
    held = rows.where(F.col("type").isin(list(RELATIONS))).withColumn("_data", F.from_json("data", "map<string, string>")).where("_data is not null")
    at = lambda key: F.try_element_at("_data", F.lit(key))
    by_id = F.col("type").isin(BY_NODE_ID)
    own = lookup({k: name for k, (_, name) in RELATIONS.items() if name}, F.col("type"), None)
    added = F.when(own.isNotNull() & at("type").isNotNull() & ~F.map_contains_key("_data", F.coalesce(own, F.lit(""))), F.create_map(F.coalesce(own, F.lit("")), at("type")))
    return held.select(
        "id",
        lookup({k: kind for k, (kind, _) in RELATIONS.items()}, F.col("type"), None).alias("type"),
        F.when(by_id, at("fromNodeId")).otherwise(at("source")).alias("src"),
        F.when(by_id, at("toNodeId")).otherwise(at("target")).alias("dst"),
        F.coalesce(F.map_concat(added, "_data"), "_data").alias("properties"),
    )


def _found(row: Column, wrapper: str, keys: list[str]) -> Column:
    """The first spelling that is there and not empty: below the wrapper, in the first
    field of a row of a result, or at the top; spellings with dots are paths from the top."""
    def at(path: str) -> Column:
        return F.nullif(F.try_variant_get(row, path, "string"), F.lit(""))

    steps = lambda key: "".join(f"['{k}']" for k in key.split("."))
    below = lambda start: F.coalesce(*[at(start + steps(k)) for k in keys])
    inside, first = (F.try_variant_get(row, p, "variant").isNotNull() for p in (f"$['{wrapper}']", "$[0]"))
    return F.when(inside, F.coalesce(below(f"$['{wrapper}']"), below("$"))).when(first, below("$[0]")).otherwise(below("$"))


def normal_nodes(results: DataFrame, row: str = "row") -> DataFrame:
    """``id, type, name, properties`` of raw node results, whatever their spelling: a bare
    object, one under ``vertex``, or a row whose first field it is. What is missing, null
    or empty is ``unknown``; a name falls back on the type and then on the id; properties
    are JSON, ``{}`` where there are none."""
    v = F.try_parse_json(row)
    part = {k: _found(v, "vertex", keys) for k, keys in NODE_KEYS.items()}
    held = results.select("*", *[c.alias(f"_{k}") for k, c in part.items()])
    kind = F.coalesce("_type", F.lit(UNKNOWN))
    return held.select(F.coalesce("_id", F.lit(UNKNOWN)).alias("id"), kind.alias("type"), F.coalesce("_name", kind).alias("name"), F.coalesce("_properties", F.lit("{}")).alias("properties"))


def normal_edges(results: DataFrame, row: str = "row") -> DataFrame:
    """``id, type, src, dst, properties`` of raw edge results, as above, under ``edge``."""
    v = F.try_parse_json(row)
    part = {k: F.coalesce(_found(v, "edge", keys), F.lit("{}" if k == "properties" else UNKNOWN)) for k, keys in EDGE_KEYS.items()}
    return results.select(*[c.alias(k) for k, c in part.items()])


def _is(kind: str, props: Column, key: str) -> Column:
    """Whether a property of a JSON value is of a kind."""
    value = lambda to: F.try_variant_get(props, f"$['{key}']", to)
    shape = F.schema_of_variant(value("variant"))
    if kind == "count":
        return (shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")) & (value("double") >= 0)
    if kind == "list":
        return shape.startswith("ARRAY")
    return (shape == "STRING") & ((F.length(value("string")) > 0) if kind == "text" else F.lit(True))


def node_errors(nodes: DataFrame, rules: dict[str, dict] | None = None) -> DataFrame:
    """Adds ``errors`` (empty where a node is sound) to nodes with ``id, type`` and
    ``properties`` as JSON: no id, a type that is none, no properties, and for types that
    have rules a missing property or one that is not what it must be. ``rules`` takes the
    place of the stated ones, by type."""
    props = F.try_parse_json("properties")
    object_ = F.coalesce(F.schema_of_variant(props).startswith("OBJECT"), F.lit(False))
    told = [
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.lit("no id")),
        F.when(~F.coalesce(F.col("type").isin(NODE_TYPES), F.lit(False)), F.concat(F.lit("type "), F.coalesce("type", F.lit("null")))),
        F.when(~object_, F.lit("no properties")),
    ]
    for kind, needs in (REQUIRED if rules is None else rules).items():
        for key, must in needs.items():
            there = F.try_variant_get(props, f"$['{key}']", "variant").isNotNull()
            wrong = F.when(~there, F.lit(f"missing {key}"))
            if must:
                wrong = wrong.when(~F.coalesce(_is(must, props, key), F.lit(False)), F.lit(f"bad {key}"))
            told.append(F.when((F.col("type") == kind) & object_, wrong))
    return nodes.withColumn("errors", F.array_compact(F.array(*told)))


def edge_errors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``errors`` to edges with ``id, type, src, dst`` and ``properties`` as JSON: no
    id, a type that is none, no end, no properties, and ends that no node has. Ids of
    nodes meet each end once; a repeated id counts once."""
    ids = nodes.select(F.col("id").alias("_id")).where("_id is not null").distinct()
    end = lambda at: ids.select(F.col("_id").alias(f"_{at}"))
    held = edges.join(end("src"), F.col("src") == F.col("_src"), "left").join(end("dst"), F.col("dst") == F.col("_dst"), "left")
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    object_ = F.coalesce(F.schema_of_variant(F.try_parse_json("properties")).startswith("OBJECT"), F.lit(False))
    told = [F.when(none("id"), F.lit("no id")), F.when(~F.coalesce(F.col("type").isin(EDGE_TYPES), F.lit(False)), F.concat(F.lit("type "), F.coalesce("type", F.lit("null"))))]
    for at in ("src", "dst"):
        told.append(F.when(none(at), F.lit(f"no {at}")).when(F.col(f"_{at}").isNull(), F.concat(F.lit(f"{at} not there: "), F.col(at))))
    told.append(F.when(~object_, F.lit("no properties")))
    return held.withColumn("errors", F.array_compact(F.array(*told))).drop("_src", "_dst")
