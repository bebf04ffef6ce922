"""Languages, lines and quality of code, chunk rules, file search, semantic similarity,
duplicates, edits of graphs and timing of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as T
from ..operators import changes as H
from ..operators import chunking as K
from ..operators import code_quality as Q
from ..operators import filesearch as S
from ..operators import graph as G
from ..operators import metrics as R
from ..operators import similarity as M
from ..operators import vector as V
from ..plans.lineage import shared_dir
from ..sources.collections import PointStore
from .base import Catalog
from .graphs import BOTH, EDGES, edges_of, nodes_of, start_of
from .texts import INTENT_SQL, _jac, _kw, _pairs, asked, asked_sql
from .vectors import _embedded

C = Catalog()
query = C.query
PAIRS = "SELECT a.item_id AS i, b.item_id AS j, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"


def _vector(text: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    slots = f"list_transform({words}, lambda w: ('0x' || substr(md5(w), 1, 4))::INT % 64)"
    return f"list_transform(range(64), lambda i: len(list_filter({slots}, lambda x: x = i))::DOUBLE)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _hits(text: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, {_quoted(p)})::INT" for p in patterns) + ")"


def _scores() -> str:
    others = ", ".join(f"{{'score': {_hits('h', p)}, 'name': '{name}'}}" for name, p in L.PATTERNS.items() if name != "javascript")
    return f"[{{'score': CASE WHEN ts > 0 THEN ts + js ELSE js END, 'name': CASE WHEN ts > 0 THEN 'typescript' ELSE 'javascript' END}}, {others}]"


@query(f"""WITH p AS (SELECT page_id, substr(html, 1, {L.HEAD}) AS h FROM pages WHERE html IS NOT NULL), q AS (SELECT page_id, h, {_hits('h', L.TYPED)} AS ts, {_hits('h', L.PATTERNS['javascript'])} AS js FROM p),
s AS (SELECT page_id, {_scores()} AS s FROM q), m AS (SELECT page_id, s, list_max(list_transform(s, lambda x: x.score)) AS most, list_sum(list_transform(s, lambda x: x.score)) AS total FROM s)
SELECT page_id, CASE WHEN most < 1 THEN 'unknown' ELSE list_filter(s, lambda x: x.score = most)[1].name END AS language, round(CASE WHEN most < 1 THEN 0.0 ELSE most / total END, 6)::DOUBLE AS confidence FROM m""")
def language_by_content(t):
    rows = t("pages").where("html is not null").select("page_id", L.language_of(F.col("html")).alias("l"))
    return rows.select("page_id", "l.language", F.round("l.confidence", 6).alias("confidence"))


KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches(trim(x), {_quoted(p)})' for p in patterns)} THEN '{kind}'" for kind, patterns in L.LINE_KINDS.items()) + " ELSE 'other' END"


@query(f"WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x FROM pages) SELECT page_id, {KIND} AS kind, count(*)::BIGINT AS n FROM l GROUP BY 1, 2")
def line_kinds(t):
    lines = t("pages").select("page_id", F.explode(F.split("html", "\n")).alias("x"))
    return lines.groupBy("page_id", L.line_kind(F.col("x")).alias("kind")).agg(F.count("*").alias("n"))


@query(r"""WITH b AS (SELECT page_id, list_filter(list_transform(string_split(html, chr(10)), lambda x: regexp_extract(x, '^([ \t]+)\S', 1)), lambda x: x <> '') AS b FROM pages)
SELECT page_id, CASE WHEN len(list_filter(b, lambda x: contains(x, chr(9)))) > 0 AND len(list_filter(b, lambda x: contains(x, ' '))) > 0 THEN 'mixed' WHEN len(list_filter(b, lambda x: contains(x, chr(9)))) > 0 THEN 'tabs' WHEN len(b) > 0 THEN 'spaces' ELSE 'none' END AS style,
round(CASE WHEN len(b) > 0 THEN list_sum(list_transform(b, lambda x: length(x))) / len(b) ELSE 0.0 END, 6)::DOUBLE AS size FROM b WHERE b IS NOT NULL""")
def indentation(t):
    return t("pages").where("html is not null").select("page_id", Q.indentation(F.col("html")).alias("i")).select("page_id", "i.style", F.round("i.size", 6).alias("size"))


def _aside(text: str) -> str:
    for p in Q.ASIDE:
        text = f"regexp_replace({text}, {_quoted(p)}, ' ', 'g')"
    return text


N = "(length({0}) - length(replace({0}, '{1}', '')))"
DIFF = lambda a, b, x="c": f"{N.format(x, a)} - {N.format(x, b)}"


@query(f"""WITH c AS (SELECT page_id, {_aside('html')} AS c FROM pages WHERE html IS NOT NULL), n AS (SELECT page_id, {DIFF('(', ')')} AS round, {DIFF('{', '}')} AS curly, {DIFF('[', ']')} AS square, {N.format('c', '`')} % 2 AS template FROM c)
SELECT page_id, round, curly, square, template, round = 0 AND curly = 0 AND square = 0 AND template = 0 AS safe FROM n""")
def symbol_balance(t):
    rows = t("pages").where("html is not null").select("page_id", Q.symbol_balance(F.col("html")).alias("b"))
    return rows.select("page_id", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("round", "curly", "square", "template")], "b.safe")


@query()
def chunk_quality(t):
    return t("pages").where("html is not null").select("page_id", F.round(Q.chunk_quality(F.col("html")), 6).alias("quality"))


@query(r"""WITH l AS (SELECT page_id, string_split(html, chr(10)) AS l FROM pages WHERE html IS NOT NULL),
e AS (SELECT page_id, l, list_distinct(list_append(list_filter(list_transform(range(2, len(l) + 1), lambda i: CASE WHEN regexp_matches(l[i], '^\s*(function|class|def|interface|struct|fn|func|public|private|async)\b') THEN i - 1 END), lambda i: i IS NOT NULL), len(l))) AS e FROM l),
c AS (SELECT page_id, l, list_sort(e) AS e, unnest(range(1, len(e) + 1)) AS k FROM e), b AS (SELECT page_id, k - 1 AS chunk, CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END AS start_line, e[k] AS end_line, l FROM c)
SELECT page_id, chunk, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, md5(array_to_string(l[start_line:end_line], chr(10))) AS digest FROM b WHERE trim(translate(array_to_string(l[start_line:end_line], chr(10)), chr(10) || chr(13) || chr(9), '   ')) <> ''""")
def definition_chunks(t):
    rows = K.chunks(t("pages"), K.definition_ends(F.col("html")), "html", ("page_id",))
    return rows.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("chunk", "start_line", "end_line")], F.md5("content").alias("digest"))


# chunks of four lines, as both engines cut them
FOUR = """l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, l, unnest(range(0, (len(l) + 3) // 4)) AS chunk FROM l),
c AS (SELECT doc_id, chunk::INT AS chunk, 4 * chunk + 1 AS s, least(4 * chunk + 4, len(l)) AS e, array_to_string(l[4 * chunk + 1:least(4 * chunk + 4, len(l))], chr(10)) AS content FROM u),
f AS (SELECT * FROM c WHERE trim(translate(content, chr(10) || chr(13) || chr(9), '   ')) <> '')"""


def _four(t):
    return K.chunks(t("documents"), K.fixed_ends(F.col("text"), 4))


def _summary(rows):
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk", "start_line", "end_line")], F.md5("content").alias("digest"))


@query(f"""WITH {FOUR}, n AS (SELECT *, row_number() OVER w AS n, length(content) < 100 AND lead(chunk) OVER w IS NOT NULL AS small FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)),
r AS (SELECT *, small AND (n - coalesce(max(CASE WHEN NOT small THEN n END) OVER (PARTITION BY doc_id ORDER BY chunk ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS begins FROM n),
g AS (SELECT *, CASE WHEN coalesce(lag(begins) OVER w, false) THEN lag(chunk) OVER w ELSE chunk END AS g FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY chunk))
SELECT doc_id, g::BIGINT AS chunk, min(s)::BIGINT AS start_line, max(e)::BIGINT AS end_line, md5(string_agg(content, chr(10) ORDER BY chunk)) AS digest FROM g GROUP BY doc_id, g""")
def paired_chunks(t):
    return _summary(K.pair_small(_four(t)))


@query(f"""WITH {FOUR}, h AS (SELECT *, md5(content) AS h FROM f) SELECT DISTINCT a.doc_id, a.chunk::BIGINT AS chunk_a, b.chunk::BIGINT AS chunk_b FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.h = b.h AND a.chunk < b.chunk""")
def same_chunks(t):
    return K.same_chunks(_four(t), F.sha2("content", 256)).select("doc_id", F.col("chunk_a").cast("long"), F.col("chunk_b").cast("long"))


@query(f"""WITH {FOUR}, n AS (SELECT doc_id, chunk, content AS a, lead(content) OVER w AS b, s AS sa, (lead(s) OVER w) - 2 AS sb FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)), m AS (SELECT *, string_split(a, chr(10)) AS la FROM n WHERE b IS NOT NULL)
SELECT doc_id, chunk::BIGINT AS chunk, md5(CASE WHEN sa + len(la) - sb <= 0 THEN a || chr(10) || b ELSE array_to_string(list_concat(la[1:greatest(len(la) - (sa + len(la) - sb), 0)], string_split(b, chr(10))), chr(10)) END) AS digest FROM m""")
def merged_contents(t):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("chunk")
    rows = _four(t).withColumn("b", F.lead("content").over(w)).withColumn("sb", F.lead("start_line").over(w) - 2).where("b is not null")
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5(K.merge_contents(F.col("content"), F.col("b"), F.col("start_line"), F.col("sb"))).alias("digest"))


TYPED = f"{FOUR}, y AS (SELECT *, CASE WHEN length(content) % 3 = 0 THEN 'generic' WHEN length(content) % 3 = 1 THEN 'import' ELSE 'function' END AS type, (length(content) % 17)::DOUBLE AS complexity, length(content) AS size FROM f)"


def _typed(t):
    n = F.length("content")
    kind = F.when(n % 3 == 0, "generic").when(n % 3 == 1, "import").otherwise("function")
    return _four(t).withColumns({"type": kind, "complexity": (n % 17).cast("double"), "size": n})


@query(f"""WITH RECURSIVE {TYPED}, k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS n FROM y),
r AS (SELECT doc_id, n, chunk, chunk AS "into", type AS held, size AS total, complexity AS sum FROM k WHERE n = 1 UNION ALL
SELECT z.doc_id, z.n, z.chunk, CASE WHEN z.j THEN z."into" ELSE z.chunk END, CASE WHEN z.j THEN z.held ELSE z.type END, CASE WHEN z.j THEN z.total + z.size + 1 ELSE z.size END, CASE WHEN z.j THEN z.sum + z.complexity ELSE z.complexity END FROM
(SELECT k.doc_id, k.n, k.chunk, k.type, k.size, k.complexity, r."into", r.held, r.total, r.sum, r.total + k.size <= 1000 AND (r.held = k.type OR (r.held IN ('function', 'class', 'import') AND k.type = 'generic') OR (k.type IN ('function', 'class', 'import') AND r.held = 'generic'))
AND r.held NOT IN ('function', 'class') AND r.sum + k.complexity <= 50 AS j FROM r JOIN k ON k.doc_id = r.doc_id AND k.n = r.n + 1) z)
SELECT doc_id, chunk::BIGINT AS chunk, "into"::BIGINT AS "into" FROM r""")
def boundary_groups(t):
    return K.boundary_groups(_typed(t)).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("into").cast("long").alias("into"))


@query()
def structural_groups(t):
    return K.structural_groups(_typed(t)).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("into").cast("long").alias("into"))


@query(f"""WITH p AS ({PAIRS}), v AS (SELECT i, j, x, y, {_kw('x')} AS a, {_kw('y')} AS b, {_vector('x')} AS u, {_vector('y')} AS v FROM p)
SELECT i, j, round(CASE WHEN length(x) < 10 OR length(y) < 10 THEN (CASE WHEN x = y THEN 1.0 ELSE {_jac('a', 'b')} END) WHEN list_sum(u) = 0 OR list_sum(v) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, list_cosine_similarity(u, v))) END, 6)::DOUBLE AS score FROM v""")
def semantic_similarity(t):
    return _pairs(t).select("i", "j", F.round(M.semantic(F.col("x"), F.col("y")), 6).alias("score"))


@query(f"""WITH k AS (SELECT item_id, text, {_kw('text')} AS w FROM benchmark)
SELECT a.item_id AS id, EXISTS (SELECT 1 FROM k b WHERE b.item_id <> a.item_id AND (a.text = b.text OR {_jac('a.w', 'b.w')} >= 0.9)) AS is_duplicate FROM k a""")
def duplicates_and_uniques(t):
    return M.duplicates(t("benchmark"), "item_id", "text")


STOP = "[" + ", ".join(f"'{w}'" for w in M.COMMON) + "]"
AW = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains(" + STOP + ", w))"
CX = "round(least(1.0, (len(list_distinct(string_split({0}, ''))) * 0.3 + len(string_split({0}, chr(10))) * 0.4 + len({1}) * 0.3) / 1000), 6)::DOUBLE"


@query(f"""WITH p AS ({PAIRS}), k AS (SELECT *, {AW.format('x')} AS a, {AW.format('y')} AS b FROM p)
SELECT i, j, abs(length(x) - length(y))::BIGINT AS difference, round(least(length(x), length(y)) / greatest(length(x), length(y), 1)::DOUBLE, 6) AS ratio,
round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_filter(a, lambda w: list_contains(b, w))) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 6)::DOUBLE AS overlap, {CX.format('x', 'a')} AS complexity_a, {CX.format('y', 'b')} AS complexity_b FROM k""")
def pair_analysis(t):
    rows = _pairs(t).select("i", "j", M.analyse_pair(F.col("x"), F.col("y")).alias("d"))
    return rows.select("i", "j", F.col("d.difference").cast("long").alias("difference"), *[F.round(f"d.{c}", 6).alias(c) for c in ("ratio", "overlap", "complexity_a", "complexity_b")])


FILES = """files AS (SELECT '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '/' || w[1] || '_' || w[2] || '_' || doc_id || '.' || coalesce(lang, 'und') AS path, coalesce(text, '') AS description, doc_id * 37 % 1000 AS modified
FROM (SELECT *, list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), ['one', 'two']) AS w FROM documents))"""


def _files(t):
    words = F.concat(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1)), F.array(F.lit("one"), F.lit("two")))
    lang = F.coalesce("lang", F.lit("und"))
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), lang, F.lit("/"), F.get(words, F.lit(0)), F.lit("_"), F.get(words, F.lit(1)), F.lit("_"), "doc_id", F.lit("."), lang)
    return t("documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("description"), (F.col("doc_id") * 37 % 1000).alias("modified"))


STOPS, NO_PATH = "[" + ", ".join(f"'{w}'" for w in T.QUERY_STOP) + "]", "[" + ", ".join(f"'{w}'" for w in S.NO_PATH) + "]"
WORDS = rf"list_concat(list_concat(list_filter(list_transform(regexp_split_to_array(s, '\s+'), lambda w: regexp_replace(w, '[^\w\x{{4e00}}-\x{{9fa5}}]', '', 'g')), lambda w: length(w) > 1 AND NOT list_contains({STOPS}, w)), regexp_extract_all(s, '\.\w+$')), list_filter(regexp_extract_all(s, '[\w-]+'), lambda w: length(w) > 2))"
# parts of queries: places are those of a word's first place, as both engines order them alike
PARTS = rf"""k AS (SELECT *, {WORDS} AS words, list_filter(regexp_split_to_array(s, '\s+'), lambda w: regexp_matches(w, '^[\w-]+(\.[\w-]+)+$')) AS names FROM intents),
e AS (SELECT *, CASE intent WHEN 'EXACT_FILENAME' THEN names WHEN 'PATH_PATTERN' THEN list_filter(words, lambda w: NOT starts_with(w, '.') AND length(w) > 2 AND NOT list_contains({NO_PATH}, w)) WHEN 'EXTENSION_SEARCH' THEN list_filter(words, lambda w: starts_with(w, '.') AND length(w) > 1) ELSE [] END AS own FROM k),
u AS (SELECT *, unnest(own) AS text FROM e), parts AS (SELECT query_id, list_position(own, text) AS part, CASE WHEN intent = 'PATH_PATTERN' THEN 'path' ELSE 'name' END AS field, text, 1.0::DOUBLE AS weight, CASE WHEN intent = 'EXTENSION_SEARCH' THEN text END AS tag FROM u GROUP BY ALL
UNION ALL SELECT query_id, part, field, query, weight, NULL FROM e, (VALUES ('EXACT_FILENAME', 0, 'name', 1.0::DOUBLE), ('PATH_PATTERN', 0, 'path', 1.0), ('EXTENSION_SEARCH', 0, 'name', 1.0), ('SEMANTIC_DESCRIPTION', 0, 'description', 1.0), ('SEMANTIC_DESCRIPTION', 1, 'name', 1.0),
('HYBRID_QUERY', 0, 'description', 0.85), ('HYBRID_QUERY', 1, 'name', 0.85 * 0.8), ('HYBRID_QUERY', 2, 'path', 0.85 * 0.6)) w(kind, part, field, weight) WHERE kind = intent AND len(own) = 0)"""


@query(f"""WITH asked AS ({asked_sql('benchmark', 'item_id')}), {INTENT_SQL}, {FILES}, {PARTS},
i AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, '.' || regexp_extract(path, '[.]([^.]+)$', 1) AS tag FROM files), p AS (SELECT path, tag, 'name' AS field, {_vector('name')} AS v FROM i UNION ALL SELECT path, tag, 'path', {_vector('path')} FROM i UNION ALL SELECT path, tag, 'description', {_vector('description')} FROM i),
q AS (SELECT *, {_vector('text')} AS v FROM parts), c AS (SELECT q.query_id, q.part, q.weight, p.path, round(CASE WHEN list_sum(q.v) > 0 AND list_sum(p.v) > 0 THEN list_cosine_similarity(q.v, p.v) ELSE 0.0 END, 6) AS score FROM q JOIN p ON p.field = q.field AND (q.tag IS NULL OR q.tag = p.tag)),
b AS (SELECT * FROM c WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, path) <= 50),
o AS (SELECT query_id, path, min({{'part': part, 'score': score * weight}}).score AS score FROM b GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY floor(o.score / 0.01 + 1e-9) DESC, modified DESC, path)::INTEGER AS rank, path, round(o.score, 6) AS score FROM o JOIN files USING (path))
SELECT query_id, rank, path, score, intent FROM r JOIN intents USING (query_id) WHERE rank <= 100""")
def file_search(t):
    embed = V.hashed_vectors
    found = S.search_files(S.file_index(_files(t), embed), asked(t("benchmark"), "item_id"), embed)
    return found.withColumn("score", F.round("score", 6))


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


TYPEDIN = "SELECT n_nationkey AS id, lower(substr(n_name, 1, 1 + n_nationkey % 2)) AS q FROM nation"


@query(f"""WITH q AS ({TYPEDIN}) SELECT id, array_to_string(list_concat(list_concat(list_transform(list_filter({_listed(S.EXTENSIONS)}, lambda x: contains(x, q) OR contains(q, replace(x, '.', ''))), lambda x: '*' || x), list_filter({_listed(S.FILE_NAMES)}, lambda x: contains(x, q))),
list_transform(list_filter({_listed(S.DIRECTORIES)}, lambda x: contains(x, q)), lambda x: x || '/'))[1:10], ' ') AS suggestions FROM q""")
def file_suggestions(t):
    q = F.lower(F.substring("n_name", F.lit(1), F.lit(1) + F.col("n_nationkey") % 2))
    return t("nation").select(F.col("n_nationkey").alias("id"), F.array_join(S.file_suggestions(q), " ").alias("suggestions"))


@query("""WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations) SELECT conv_id, turn, array_to_string(list_concat(list_concat(list_concat(
""" + "), ".join(f"CASE WHEN contains(q, '{k}') THEN {_listed(v)} ELSE [] END" for k, v in S.TOPICS.items()).replace("), CASE", ", CASE", 1) + ")[1:5], ', ') AS suggestions FROM q")
def topic_suggestions(t):
    return t("conversations").select("conv_id", "turn", F.array_join(S.topic_suggestions(F.coalesce("text", F.lit(""))), ", ").alias("suggestions"))


@query(f"WITH {EDGES} SELECT src, dst, type FROM edges WHERE NOT (src IN ('n1', 'n2', 'p3') AND type IN ('LOCATED_IN', 'CALLS'))")
def delete_edges(t):
    edges = edges_of(t)
    gone = edges.join(start_of(t, "n1", "n2", "p3").withColumnRenamed("id", "src"), "src", "left_semi").where("type in ('LOCATED_IN', 'CALLS')")
    return G.delete_edges(edges, gone).select("src", "dst", "type")


@query(f"WITH {BOTH} SELECT e.src, e.dst, e.type, a.type AS src_type, a.name AS src_name, b.type AS dst_type, b.name AS dst_name FROM edges e LEFT JOIN nodes a ON a.id = e.src LEFT JOIN nodes b ON b.id = e.dst")
def edge_ends(t):
    return G.with_ends(edges_of(t), nodes_of(t)).select("src", "dst", "type", "src_type", "src_name", "dst_type", "dst_name")


@query(f"""WITH RECURSIVE {BOTH}, u AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
w(id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT u.dst, min(w.component) FROM w JOIN u ON u.src = w.id JOIN recurring.w AS o ON o.id = u.dst WHERE w.component < o.component GROUP BY 1),
m AS (SELECT (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes)::DOUBLE AS average_degree, (SELECT count(*) FROM edges WHERE type = 'IMPORTS') AS external, (SELECT count(*) FROM nodes WHERE type = 'Part') AS files, (SELECT count(DISTINCT component) FROM w) AS components)
SELECT unnest(list_filter([{', '.join(f"CASE WHEN {test} THEN '{text}' END" for test, text in G.INSIGHTS)}], lambda x: x IS NOT NULL)) AS insight FROM m""")
def graph_insights(t):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    edges, nodes = edges_of(t), nodes_of(t)
    components = G.components(edges, nodes).agg(F.count_distinct("component").alias("components"))
    parts = [one(edges, "e"), one(nodes, "n"), one(edges.where("type = 'IMPORTS'"), "external"), one(nodes.where("type = 'Part'"), "files"), components]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.join(F.broadcast(p))  # single rows
    return G.insights(all_.withColumn("average_degree", F.col("e") / F.col("n")))


@query("SELECT user_id, count(*)::BIGINT AS waiting, CASE WHEN count(*) >= 50 THEN 100 WHEN count(*) >= 20 THEN 1000 ELSE 5000 END AS delay, ceil(count(*) / 20.0)::BIGINT AS batches FROM events GROUP BY user_id")
def flush_delays(t):
    waiting = t("events").groupBy("user_id").agg(F.count("*").alias("waiting"))
    return waiting.select("user_id", "waiting", H.flush_delay(F.col("waiting")).alias("delay"), F.ceil(F.col("waiting") / 20).alias("batches"))


@query("""WITH l AS (SELECT event_type, user_id, max(ts) AS ts FROM events GROUP BY 1, 2), n AS (SELECT max(ts) AS now FROM events), r AS (SELECT event_type, user_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, user_id) AS k FROM l, n WHERE ts > now - INTERVAL 3 DAY)
SELECT event_type, user_id, ts::TIMESTAMP AS ts FROM r WHERE k <= 20""")
def live_cache(t):
    events = t("events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return H.live_entries(events, "event_type", "user_id", "ts", now, "3 days", 20).select("event_type", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""WITH r AS (SELECT event_id, event_type, value, count(*) FILTER (value < 20) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 2 PRECEDING) AS low FROM events)
SELECT event_id, event_type, CASE WHEN value < 10 THEN 'critical' WHEN value < 15 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE low = 3""")
def low_streaks(t):
    events = t("events").withColumn("at", F.struct("ts", "event_id"))
    return R.low_streaks(events, "at", "value", 20.0, 3, ["event_type"]).select("event_id", "event_type", "severity")


@query("""WITH l AS (SELECT value FROM events ORDER BY event_id DESC LIMIT 50), s AS (SELECT count(*) AS n, avg((value >= 50)::INT) AS share FROM l),
m AS (SELECT n, 0.5 * CASE WHEN share > 0.8 THEN 1.1 WHEN share > 0.6 THEN 1.02 WHEN share < 0.1 THEN 0.9 WHEN share < 0.2 THEN 0.95 ELSE 1.0 END AS moved FROM s)
SELECT (CASE WHEN n >= 10 AND abs(least(0.95, greatest(0.3, moved)) - 0.5) > 0.05 THEN least(0.95, greatest(0.3, moved)) ELSE 0.5 END)::DOUBLE AS threshold FROM m""")
def adaptive_threshold(t):
    return M.adaptive_threshold(t("events").withColumn("score", F.col("value") / 100), "event_id", "score", 0.5)


@query("""WITH d AS (SELECT min(doc_id) OVER (PARTITION BY md5(text)) AS "group", doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT "group", count(*)::BIGINT AS n, arg_max(doc_id, n * 1000000000 - doc_id) AS representative FROM d GROUP BY 1""")
def group_details(t):
    from pyspark.sql import Window

    docs = t("documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    groups = docs.select("id", F.min("id").over(Window.partitionBy(F.md5("text"))).alias("group"))
    return M.group_details(groups, docs)


@query(f"""WITH e AS {_embedded('doc_id', "(SELECT doc_id, coalesce(text, '') AS text FROM documents)")}, d AS (SELECT doc_id, source, coalesce(text, '') AS text, v FROM documents JOIN e ON e.id = doc_id WHERE source IS NOT NULL),
p AS (SELECT a.source, CASE WHEN a.text = b.text THEN 1.0 WHEN list_sum(a.v) > 0 AND list_sum(b.v) > 0 THEN list_cosine_similarity(a.v, b.v) ELSE 0.0 END AS s FROM d a JOIN d b ON a.source = b.source AND a.doc_id < b.doc_id)
SELECT source AS "group", n, representative, round(coalesce(s, 1.0), 6) AS score FROM (SELECT source, count(*)::BIGINT AS n, arg_max(doc_id, length(text)::BIGINT * 1000000000 - doc_id) AS representative FROM d GROUP BY 1) LEFT JOIN (SELECT source, avg(s) AS s FROM p GROUP BY 1) USING (source)""")
def group_scores(t):
    """How alike the documents of a source are in the mean of all pairs."""
    return M.group_scores(t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group")), t("documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"""WITH {FOUR} SELECT a.doc_id, a.chunk::BIGINT AS chunk_a, b.chunk::BIGINT AS chunk_b FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.chunk < b.chunk AND (b.s = a.e + 1 OR (b.s <= a.e AND a.s <= b.e))""")
def adjacent_chunks(t):
    return K.similar_neighbours(_four(t)).select("doc_id", F.col("chunk_a").cast("long").alias("chunk_a"), F.col("chunk_b").cast("long").alias("chunk_b"))


YES = lambda test, w: f"CASE WHEN {test} THEN {w} ELSE 0.0 END"


@query(f"""WITH l AS (SELECT page_id, string_split(html, chr(10)) AS l FROM pages WHERE html IS NOT NULL), u AS (SELECT page_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS line, unnest(list_append(l[2:], NULL)) AS y FROM l)
SELECT page_id, line, round(least(1.0, {YES("trim(x) = ''", 0.3)} + {YES(f"regexp_matches(x, {_quoted(K.CLOSERS)})", 0.4)} + {YES(f"coalesce(regexp_matches(y, {_quoted(K.STARTS)}), false)", 0.4)} + {YES("regexp_matches(trim(x), '^(//|#|[*])')", 0.2)}), 6)::DOUBLE AS score FROM u""")
def boundary_scores(t):
    from pyspark.sql import Window

    lines = t("pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("at", "x"))
    lines = lines.withColumn("y", F.lead("x").over(Window.partitionBy("page_id").orderBy("at")))
    return lines.select("page_id", (F.col("at") + 1).cast("long").alias("line"), F.round(K.boundary_score(F.col("x"), F.col("y")), 6).alias("score"))


@query(f"""WITH l AS (SELECT page_id, html, string_split(html, chr(10)) AS l FROM pages WHERE html IS NOT NULL)
SELECT page_id, round(least(1.0, {YES(f"regexp_matches(html, {_quoted(K.STARTS)})", 0.3)} + {YES(f"regexp_matches(trim(html), {_quoted(K.CLOSERS)})", 0.2)} + {YES("regexp_matches(trim(html), '^(//|#|/[*])')", 0.1)} + {YES("len(l) < 10", 0.2)} + {YES("len(list_filter(l, lambda x: length(trim(x)) > 2)) * 2 > len(l)", 0.2)}), 6)::DOUBLE AS quality FROM l""")
def overlap_quality(t):
    return t("pages").where("html is not null").select("page_id", F.round(K.overlap_quality(F.col("html")), 6).alias("quality"))


@query("SELECT o_orderkey AS id, ext, ext IN ('ts', 'js', 'tsx', 'jsx', 'py', 'java', 'cpp', 'c', 'h', 'hpp', 'md', 'txt') AS to_vector, ext IN ('ts', 'js', 'tsx', 'jsx', 'py', 'java', 'cpp', 'c', 'h', 'hpp') AS to_graph FROM (SELECT o_orderkey, ['ts', 'md', 'png', 'py'][o_orderkey % 4 + 1] AS ext FROM orders)")
def routed_changes(t):
    ext = F.get(F.array(*map(F.lit, ("ts", "md", "png", "py"))), (F.col("o_orderkey") % 4).cast("int"))
    return H.routed(t("orders").select(F.col("o_orderkey").alias("id"), ext.alias("ext")), F.col("ext"))


@query("SELECT 'c' || (label % 2) AS collection, count(*)::BIGINT AS points, 64 AS size FROM embeddings WHERE vec_id % 7 <> 0 GROUP BY 1")
def point_store(t):
    """Upserts, repeated upserts and deletes in two collections."""
    spark = t("region").sparkSession
    store = PointStore(spark, f"{shared_dir(spark)}/points-{uuid.uuid4().hex}")
    points = t("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label")
    for label in (0, 1):
        some = points.where(F.col("label") % 2 == label)
        store.upsert(f"c{label}", some, 64)
        store.upsert(f"c{label}", some.where("id % 3 = 0"), 64)
        store.delete(f"c{label}", some.where("id % 7 = 0").select("id"))
    return store.info()


@query("""WITH p AS (SELECT vec_id, label, embedding FROM embeddings), q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT 'project-a' AS collection, 'cosine' AS distance, vec_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS score, 1 AS down FROM p, q WHERE label % 2 = 0 UNION ALL SELECT 'b', 'euclid', vec_id, list_distance(embedding::DOUBLE[], q::DOUBLE[]), -1 FROM p, q WHERE label % 2 = 1),
r AS (SELECT *, count(*) OVER (PARTITION BY collection) AS points, row_number() OVER (PARTITION BY collection ORDER BY -down * score, vec_id::VARCHAR) AS k FROM s)
SELECT collection, distance, points, vec_id::VARCHAR AS id, CASE WHEN collection = 'project-a' THEN 'a' END AS project_id, round(score, 6) AS score FROM r WHERE k <= 10""")
def created_collections(t):
    """Two collections of a stated size and distance, and the nearest in each."""
    spark = t("region").sparkSession
    store = PointStore(spark, f"{shared_dir(spark)}/points-{uuid.uuid4().hex}")
    points = t("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label")
    asked = [float(x) for x in t("embeddings").where("vec_id = 0").first()["embedding"]]
    out = None
    for i, (name, distance) in enumerate((("project-a", "cosine"), ("b", "euclid"))):
        store.create(name, 64, distance)
        store.put(name, points.where(F.col("label") % 2 == i))
        found = store.nearest(name, asked).select(F.lit(name).alias("collection"), "id", F.col("project_id") if i == 0 else F.lit(None).cast("string").alias("project_id"), F.round("score", 6).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out.join(store.listed().select("collection", "distance", "points"), "collection").select("collection", "distance", "points", "id", "project_id", "score")


@query("""SELECT c_custkey AS id, '/p/' || c_custkey AS path, c_mktsegment AS status FROM customer WHERE c_custkey % 5 <> 0""")
def migrated_states(t):
    """States that were kept as JSON texts become rows; broken ones go."""
    text = F.when(F.col("c_custkey") % 5 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.concat(F.lit("/p/"), "c_custkey").alias("path"), F.col("c_mktsegment").alias("status"))))
    return H.migrate_json(t("customer").select(text.alias("state")), "state", "id long, path string, status string", "id")
