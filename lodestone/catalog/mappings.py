"""Parsed rows and raw results as graphs, and checks of graphs, over rows of parts.

The rows are made of parts by one expression that both engines read, so they grow with
the table; some of them lack what they should have.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping as M
from .base import Catalog

C = Catalog()
query = C.query

KINDS = [*M.ENTITIES, *M.RELATIONS, "comment"]
KIND = "CASE p_partkey % {} {} END".format(len(KINDS), " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)))
DATA = """CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 'no json' WHEN p_partkey % 3 = 0 THEN concat('{"callName":"', p_brand, '","fromNodeId":"x', p_partkey, '","toNodeId":"x', p_partkey + 1, '","type":"direct"}')
WHEN p_partkey % 5 = 0 THEN concat('{"flowType":"own","source":"x', p_partkey, '","target":"x', p_partkey + 2, '","type":"', p_brand, '"}') ELSE concat('{"source":"x', p_partkey, '","target":"x', p_partkey + 3, '","type":"', p_brand, '"}') END"""
PARSED = {"id": "concat('x', p_partkey)", "type": KIND, "name": "p_name", "path": "concat('f', p_partkey % 50)", "line": "p_size", "data": DATA}


def _sql(columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM part"


def _rows(t, columns: dict[str, str]):
    return t("part").select(*[F.expr(e).alias(k) for k, e in columns.items()])


def _case(values: dict, key: str, other: str) -> str:
    return f"CASE {key} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in values.items())} ELSE {other} END"


@query(f"""WITH p AS ({_sql(PARSED)}) SELECT id, {_case(M.NODE_KINDS, 'type', "'Chunk'")} AS type, name, path, line FROM p WHERE type IN ({', '.join(map(repr, M.ENTITIES))})""")
def mapped_nodes(t):
    return M.to_nodes(_rows(t, PARSED))


OWN = _case({k: n for k, (_, n) in M.RELATIONS.items() if n}, "type", "NULL")


@query(f"""WITH p AS ({_sql(PARSED)}), d AS (SELECT id, type, data::JSON AS d, {OWN} AS own FROM p WHERE json_valid(data) AND type IN ({', '.join(map(repr, M.RELATIONS))})),
k AS (SELECT *, json_keys(d) AS keys, CASE WHEN type IN ('call', 'data-flow') THEN d->>'$.fromNodeId' ELSE d->>'$.source' END AS src, CASE WHEN type IN ('call', 'data-flow') THEN d->>'$.toNodeId' ELSE d->>'$.target' END AS dst FROM d)
SELECT id, {_case({k: e for k, (e, _) in M.RELATIONS.items()}, 'type', 'NULL')} AS type, src, dst,
array_to_string(list_sort(list_concat(list_transform(keys, lambda x: concat(x, '=', json_extract_string(d, concat('$.', x)))), CASE WHEN own IS NOT NULL AND NOT list_contains(keys, own) THEN [concat(own, '=', d->>'$.type')] ELSE [] END)), ';') AS properties FROM k""")
def mapped_edges(t):
    told = F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return M.to_edges(_rows(t, PARSED)).withColumn("properties", F.array_join(told, ";"))


# results in four spellings; every seventh has no type, every eleventh an empty name
RESULT = """concat('{', CASE p_partkey % 4 WHEN 0 THEN '"vertex":{' WHEN 1 THEN '"0":{' ELSE '' END, CASE p_partkey % 2 WHEN 0 THEN '"id":"' ELSE '"_id":"' END, p_partkey, '"', CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN concat(',"label":"', p_brand, '"') ELSE concat(',"tag":"', p_brand, '"') END,
CASE WHEN p_partkey % 11 = 0 THEN ',"name":""' WHEN p_partkey % 13 = 0 THEN '' ELSE concat(',"name":"n', p_partkey, '"') END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(',"props":{"size":', p_size, '}') END, CASE WHEN p_partkey % 4 IN (0, 1) THEN '}' ELSE '' END, '}')"""
RESULTS = {"row": f"CASE WHEN p_partkey % 4 = 1 THEN concat('[', substr({RESULT}, 6, length({RESULT}) - 6), ']') WHEN p_partkey % 23 = 0 THEN NULL ELSE {RESULT} END"}


def _first(alias: str, keys: list[str]) -> str:
    plain = [k for k in keys if "." not in k]
    return "coalesce({})".format(", ".join(f"nullif({alias}->>'$.{k}', '')" for k in plain))


@query(f"""WITH r AS ({_sql({'x': RESULTS['row']})}), b AS (SELECT CASE WHEN json_exists(x::JSON, '$.vertex') THEN x::JSON->'$.vertex' WHEN json_exists(x::JSON, '$[0]') THEN x::JSON->'$[0]' ELSE x::JSON END AS v FROM r),
p AS (SELECT {', '.join(f"{_first('v', keys)} AS {k}" for k, keys in M.NODE_KEYS.items())} FROM b)
SELECT coalesce(id, 'unknown') AS id, coalesce(type, 'unknown') AS type, coalesce(name, type, 'unknown') AS name, coalesce(properties, '{{}}') AS properties FROM p""")
def normalised_nodes(t):
    return M.normal_nodes(_rows(t, RESULTS))


EDGE_RESULT = """CASE p_partkey % 4 WHEN 0 THEN concat('{"edge":{"_id":"e', p_partkey, '","name":"CALLS","src":"', p_partkey, '","dst":"', p_size, '"}}') WHEN 1 THEN concat('[{"id":"e', p_partkey, '","edgeType":"USES","from":"', p_partkey, '","to":"', p_size, '","props":{"n":', p_size, '}}]')
WHEN 2 THEN concat('{"id":', p_partkey, ',"type":"', p_brand, '","source":"', p_partkey, '","target":null,"to":"t', p_size, '"}') ELSE 'broken' END"""


@query(f"""WITH r AS ({_sql({'x': EDGE_RESULT})}), j AS (SELECT CASE WHEN json_valid(x) THEN x ELSE '{{}}' END::JSON AS x FROM r), b AS (SELECT CASE WHEN json_exists(x, '$.edge') THEN x->'$.edge' WHEN json_exists(x, '$[0]') THEN x->'$[0]' ELSE x END AS v FROM j)
SELECT {', '.join(f"coalesce({_first('v', keys)}, '{'{}' if k == 'properties' else 'unknown'}') AS {k}" for k, keys in M.EDGE_KEYS.items())} FROM b""")
def normalised_edges(t):
    return M.normal_edges(_rows(t, {"row": EDGE_RESULT}))


# nodes of five kinds, with faults by the remainders of their keys
CHECKED = {
    "id": "CASE WHEN p_partkey % 29 = 0 THEN '' ELSE concat('x', p_partkey) END",
    "type": "CASE p_partkey % 5 WHEN 0 THEN 'File' WHEN 1 THEN 'Class' WHEN 2 THEN 'Import' WHEN 3 THEN 'Chunk' ELSE 'Planet' END",
    "properties": """CASE WHEN p_partkey % 31 = 0 THEN '[]' WHEN p_partkey % 5 = 0 THEN concat('{"name":"f', p_partkey, '","path":"a","language":"en","size":', p_size - 5, ',"lastModified":', CASE WHEN p_partkey % 2 = 0 THEN '"now"' ELSE '7' END, CASE WHEN p_partkey % 3 = 0 THEN ',"projectId":"p"}' ELSE '}' END)
WHEN p_partkey % 5 = 1 THEN concat('{"name":"c","parentFileId":null,"methods":', CASE WHEN p_partkey % 2 = 0 THEN '[1]' ELSE '"m"' END, CASE WHEN p_partkey % 3 = 0 THEN '}' ELSE ',"properties":[]}' END) WHEN p_partkey % 5 = 2 THEN concat('{"name":"', CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'i' END, '","path":"a"}') ELSE '{}' END""",
}
BAD = {
    "count": "(json_type(d, '$.{0}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND (d->>'$.{0}')::DOUBLE >= 0)",
    "list": "json_type(d, '$.{0}') = 'ARRAY'",
    "string": "json_type(d, '$.{0}') = 'VARCHAR'",
    "text": "(json_type(d, '$.{0}') = 'VARCHAR' AND length(d->>'$.{0}') > 0)",
}


def _rule(kind: str, key: str, must: str | None) -> str:
    bad = f" WHEN NOT coalesce({BAD[must].format(key)}, false) THEN 'bad {key}'" if must else ""
    return f"CASE WHEN type <> '{kind}' OR json_type(d) <> 'OBJECT' THEN NULL WHEN NOT json_exists(d, '$.{key}') THEN 'missing {key}'{bad} END"


RULES = ", ".join(_rule(kind, key, must) for kind, needs in M.REQUIRED.items() for key, must in needs.items())
ERRORS = f"""list_filter([CASE WHEN id = '' THEN 'no id' END, CASE WHEN type NOT IN ({', '.join(map(repr, M.NODE_TYPES))}) THEN concat('type ', type) END, CASE WHEN json_type(d) <> 'OBJECT' THEN 'no properties' END, {RULES}], lambda x: x IS NOT NULL)"""


@query(f"WITH c AS ({_sql(CHECKED)}), d AS (SELECT *, properties::JSON AS d FROM c) SELECT id, type, array_to_string({ERRORS}, '; ') AS errors FROM d")
def node_validation(t):
    return M.node_errors(_rows(t, CHECKED)).select("id", "type", F.array_join("errors", "; ").alias("errors"))


LINKED = {
    "id": "CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE concat('e', p_partkey) END",
    "type": "CASE WHEN p_partkey % 7 = 0 THEN 'LIKES' ELSE 'CALLS' END",
    "src": "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('x', p_partkey) END",
    "dst": "concat('x', p_partkey * 3 - p_size)",
    "properties": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE '{}' END",
}
END = "CASE WHEN {0} = '' THEN 'no {0}' WHEN {0} NOT IN (SELECT id FROM n) THEN concat('{0} not there: ', {0}) END"


@query(f"""WITH n AS (SELECT id FROM ({_sql(CHECKED)})), e AS ({_sql(LINKED)}) SELECT id, src, dst, array_to_string(list_filter([CASE WHEN id IS NULL THEN 'no id' END, CASE WHEN type = 'LIKES' THEN 'type LIKES' END, {END.format('src')}, {END.format('dst')}, CASE WHEN properties IS NULL THEN 'no properties' END], lambda x: x IS NOT NULL), '; ') AS errors FROM e""")
def edge_validation(t):
    return M.edge_errors(_rows(t, LINKED), _rows(t, CHECKED)).select("id", "src", "dst", F.array_join("errors", "; ").alias("errors"))
