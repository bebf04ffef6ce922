"""Text measures, similarity and duplicates over documents, pages and benchmark texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import similarity as S
from .base import Catalog

C = Catalog()
query = C.query
STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(T.STOP_WORDS))) + "]"


def _kw(text: str, least: int = 3) -> str:
    words = f"regexp_split_to_array(regexp_replace(lower({text}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+')"
    return f"list_distinct(list_filter({words}, lambda w: length(w) >= {least} AND NOT regexp_full_match(w, '\\d+') AND NOT list_contains({STOP}, w)))"


def _jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both} / (len({a}) + len({b}) - {both})::DOUBLE END)"


PAIRS = "SELECT a.item_id AS i, b.item_id AS j, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"
def _pairs(t):
    b = t("benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("i"), F.col("item_id").alias("j"), F.col("text").alias("y"))
    return b.select(F.col("item_id").alias("i"), F.col("text").alias("x")).join(nxt, "i").select("i", "j", "x", "y")


@query(f"WITH p AS ({PAIRS}), k AS (SELECT i, j, x, y, {_kw('x')} AS a, {_kw('y')} AS b FROM p) SELECT i, j, round(CASE WHEN x = y THEN 1.0 ELSE {_jac('a', 'b')} END, 6) AS score FROM k")
def keyword_similarity(t):
    return _pairs(t).select("i", "j", F.round(T.keyword_similarity(F.col("x"), F.col("y")), 6).alias("score"))


# DuckDB's edit distance counts bytes, so these are tested against plain Python
@query()
def levenshtein_similarity(t):
    return _pairs(t).select("i", "j", F.round(T.levenshtein_similarity(F.col("x"), F.col("y")), 6).alias("score"))


@query()
def hybrid_similarity(t):
    x, y = F.col("x"), F.col("y")
    return _pairs(t).select("i", "j", F.round(T.hybrid(T.levenshtein_similarity(x, y), S.semantic(x, y), T.keyword_similarity(x, y)), 6).alias("score"))


@query(f"""WITH k AS (SELECT item_id, text, {_kw('text')} AS w FROM benchmark), p AS (SELECT a.item_id AS i, b.item_id AS j, a.w AS a, b.w AS b FROM k a JOIN k b ON a.item_id < b.item_id)
SELECT i, j, round({_jac('a', 'b')}, 6) AS similarity, {_jac('a', 'b')} >= 0.6 AS is_similar FROM p WHERE len(list_intersect(a, b)) > 0""")
def batch_similarity(t):
    return S.keyword_pairs(t("benchmark"), "item_id", "text")


@query()
def cascade_similarity(t):
    x, y = F.col("x"), F.col("y")
    found = S.cascade(x == y, [("keyword", T.keyword_similarity(x, y)), ("levenshtein", T.levenshtein_similarity(x, y)), ("semantic", S.semantic(x, y))], kind="document")
    return _pairs(t).select("i", "j", found.alias("found")).select("i", "j", F.round("found.score", 6).alias("score"), "found.steps")


@query(f"""WITH k AS (SELECT doc_id, unnest({_kw('text')}) AS w FROM documents), n AS (SELECT count(*) AS n FROM documents), l AS (SELECT doc_id, count(*) AS len FROM k GROUP BY 1),
d AS (SELECT w, count(*) AS df FROM k GROUP BY 1)
SELECT k.doc_id, k.w AS word, round(1.0 / len * ln(n / (df + 1)::DOUBLE), 6) AS weight FROM k JOIN l USING (doc_id) JOIN d USING (w), n""")
def tf_idf(t):
    return S.tf_idf(t("documents"), "doc_id", "text")


@query("SELECT doc_id, substr(sha256(trim(regexp_replace(replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '(?m)[ \\t]+$', '', 'g'), chr(9), '  '), '\\n\\s*\\n', chr(10), 'g'), '(?m)//.*$', '', 'g'), '''', '\"'), '\\s+', ' ', 'g'))), 1, 16) AS hash FROM documents")
def normalized_hash(t):
    return t("documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY md5(text)")
def exact_dedup(t):
    return t("documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, line, md5(x) AS h, lag(md5(x), 1) OVER o AS a, lag(md5(x), 2) OVER o AS b, lag(md5(x), 3) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY line))
SELECT doc_id, line, (coalesce((a = h)::INT, 0) + coalesce((b = h)::INT, 0) + coalesce((c = h)::INT, 0)) >= 2 AS repetitive FROM r""")
def repetitive_overlap(t):
    lines = t("documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "x"))
    rows = lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), F.md5("x").alias("h"))
    return S.repetitive(rows, ["doc_id"], "line", "h").select("doc_id", "line", "repetitive")


@query("""WITH l AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS w, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, a.w AS a, b.w AS b FROM l a JOIN l b ON b.doc_id = a.doc_id + 1)
SELECT i, j, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 6) AS score FROM p""")
def line_jaccard(t):
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    d = t("documents").select("doc_id", lines.alias("w"))
    nxt = d.select((F.col("doc_id") - 1).alias("i"), F.col("doc_id").alias("j"), F.col("w").alias("b"))
    return d.select(F.col("doc_id").alias("i"), F.col("w").alias("a")).join(nxt, "i").select("i", "j", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("score"))


LC = "len(string_split({0}, chr(10)))"


@query(f"SELECT doc_id, round(greatest(1, 1 + log10(length(text) + 1) + 2 * log10({LC.format('text')} + 1) + 0.5 * log10(len(list_distinct(string_split(text, ''))) + 1)))::BIGINT AS c FROM documents")
def generic_complexity(t):
    return t("documents").select("doc_id", T.generic_complexity(F.col("text")).alias("c"))


def _n(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


@query(f"SELECT doc_id, round(length(text) * 0.01 + {_n('(?m)^#{1,6}[ ]+')} * 2 + {_n('```')} / 2 * 3 + {_n('[|]')} * 0.5 + {_n('(?m)^[-*+][ ]+')} + log10({LC.format('text')} + 1) * 2)::BIGINT AS c FROM documents")
def markdown_complexity(t):
    return t("documents").select("doc_id", T.markdown_complexity(F.col("text")).alias("c"))


@query(f"SELECT page_id, round(greatest(1, 1 + log10(length(html) + 1) + 2 * log10({LC.format('html')} + 1) + 0.5 * {_n('\\b(function|class|const|let|var|if|for|while|return|import|export)\\b', 'html')}))::BIGINT AS c FROM pages")
def html_complexity(t):
    return t("pages").select("page_id", T.html_complexity(F.col("html")).alias("c"))


@query()
def xml_complexity(t):
    return t("pages").select("page_id", T.xml_complexity(F.col("html")).alias("c"), T.max_nesting(F.col("html")).alias("nesting"))


@query(f"""SELECT page_id, round({_n('\\b(if|else|while|for|switch|case|try|catch|finally)\\b', 'html')} * 2 + {_n('\\b(function|method|class|interface)\\b', 'html')} * 3 + {_n('[{}]', 'html')} + {_n('[()]', 'html')} * 0.5 + 2 * log10({LC.format('html')} + 1))::BIGINT AS c,
({_n('\\b(function|class|interface)\\b', 'html')} * 10 + {_n('\\b(if|else|for|while|switch)\\b', 'html')} * 5 + {_n('[{}()\\[\\]]', 'html')})::BIGINT AS estimate FROM pages""")
def chunk_complexity(t):
    return t("pages").select("page_id", T.chunk_complexity(F.col("html")).alias("c"), T.estimated_complexity(F.col("html")).alias("estimate"))


QUALITY = f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, round(greatest(0, least(1, least(len(l) / 10.0, 0.3) + least({_n('(?m)^#{1,6}[ ]+')} * 0.1, 0.2) + least({_n('(?s)```.*?```')} * 0.15, 0.3) + least({_n('(?m)^[-*+][ ]+')} * 0.05, 0.1)
 - CASE WHEN len(list_filter(l, lambda x: trim(x) = '')) / len(l)::DOUBLE > 0.5 THEN 0.2 ELSE 0.0 END
 - CASE WHEN len(list_filter(l, lambda x: regexp_matches(trim(x), '^(//|#|/\\*|\\*|<!--)'))) / len(l)::DOUBLE > 0.8 THEN 0.3 ELSE 0.0 END)), 6)::DOUBLE AS quality FROM l"""


@query(QUALITY)
def content_quality(t):
    return t("documents").select("doc_id", F.round(T.content_quality(F.col("text"), code=False), 6).alias("quality"))


@query(f"WITH q AS ({QUALITY}) SELECT doc_id FROM q WHERE quality >= 0.3")
def quality_gate(t):
    """Documents that a stricter gate than the usual one lets through."""
    return t("documents").where(T.worth_keeping(F.col("text"), code=False, least=0.3)).select("doc_id")


@query(f"SELECT page_id, length(html)::BIGINT AS chars, {LC.format('html')}::BIGINT AS lines, {_n('[{}()\\[\\]]', 'html')}::BIGINT AS brackets, {_n('<[^>]+>', 'html')}::BIGINT AS tags, ({_n('[{}()\\[\\]]', 'html')} / length(html)::DOUBLE > 0.01) OR ({_n('<[^>]+>', 'html')} / length(html)::DOUBLE > 0.005) AS structured FROM pages")
def file_stats(t):
    h = F.col("html")
    return t("pages").select("page_id", F.length(h).cast("long").alias("chars"), T.line_count(h).cast("long").alias("lines"), T.count(h, r"[{}()\[\]]").cast("long").alias("brackets"), T.count(h, "<[^>]+>").cast("long").alias("tags"), T.structured(h).alias("structured"))


@query("SELECT page_id, " + ", ".join(f"regexp_matches(html, '{p}') AS {k}" for k, p in T.FEATURES.items()) + " FROM pages")
def code_features(t):
    return t("pages").select("page_id", *[F.col("html").rlike(T.portable(p)).alias(k) for k, p in T.FEATURES.items()])


@query("""SELECT doc_id, CASE WHEN contains(text, chr(13)) AND NOT contains(text, chr(10)) THEN 'CR' WHEN contains(text, chr(10)) AND NOT contains(text, chr(13)) THEN 'LF' ELSE 'mixed' END AS ending FROM documents""")
def line_ending(t):
    return t("documents").select("doc_id", T.line_ending(F.col("text")).alias("ending"))


EXT = list(T.LANGUAGES)
PATH = f"'/src//' || source || chr(92) || 'f' || doc_id || '.' || ([{', '.join(repr(e) for e in EXT)}])[doc_id % {len(EXT)} + 1]"


def _paths(t):
    ext = F.element_at(F.array(*[F.lit(e) for e in EXT]), (F.col("doc_id") % len(EXT) + 1).cast("int"))
    return t("documents").select("doc_id", "n_chars", F.concat(F.lit("/src//"), "source", F.lit("\\f"), "doc_id", F.lit("."), ext).alias("path"))


LANG_ROWS = ", ".join(f"('{e}', '{n}')" for e, n in T.LANGUAGES.items())
GROUP_ROWS = ", ".join(f"('{x}', '{g}')" for g, names in T.LANGUAGE_GROUPS.items() for x in names.split())


@query(f"""WITH p AS (SELECT doc_id, {PATH} AS path FROM documents), n AS (SELECT doc_id, regexp_replace(replace(path, chr(92), '/'), '/{{2,}}', '/', 'g') AS path FROM p), l(e, lang) AS (VALUES {LANG_ROWS}), g(lang, grp) AS (VALUES {GROUP_ROWS})
SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, e AS ext, lang, grp FROM n JOIN l ON e = regexp_extract(path, '[.]([^.]+)$', 1) JOIN g USING (lang)""")
def path_functions(t):
    p = F.col("path")
    lang = T.language(p)
    return _paths(t).select("doc_id", T.normal_path(p).alias("path"), T.base_name(p).alias("base"), T.directory(p).alias("dir"), T.extension(p).alias("ext"), lang.alias("lang"), T.language_group(lang).alias("grp"))


@query(f"""WITH p AS (SELECT n_chars, ([{', '.join(repr(e) for e in EXT)}])[doc_id % {len(EXT)} + 1] AS e FROM documents), l(e, lang) AS (VALUES {LANG_ROWS}), c(lang, base) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in T.LANGUAGE_COMPLEXITY.items())}),
x AS (SELECT CASE WHEN n_chars > 204800 THEN least(1.0, base + 0.2) WHEN n_chars > 102400 THEN least(1.0, base + 0.1) WHEN n_chars < 10240 THEN greatest(0.1, base - 0.1) ELSE base END AS c FROM (SELECT n_chars, coalesce(base, 0.5) AS base FROM p JOIN l USING (e) LEFT JOIN c USING (lang)))
SELECT CASE WHEN round(c, 6) <= 0.3 THEN 'simple' WHEN round(c, 6) <= 0.7 THEN 'medium' ELSE 'complex' END AS complexity, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def group_by_complexity(t):
    c = F.round(T.file_complexity(T.language(F.col("path")), F.col("n_chars")), 6)
    level = F.when(c <= 0.3, "simple").when(c <= 0.7, "medium").otherwise("complex")
    return _paths(t).groupBy(level.alias("complexity")).agg(F.count("*").alias("n"))


TIMES = ", ".join(f"('{k}', {v})" for k, v in T.LANGUAGE_TIME.items())
PRIORITIES = ", ".join(f"('{k}', {v})" for k, v in T.GROUP_PRIORITY.items())


@query(f"""WITH l(e, lang) AS (VALUES {LANG_ROWS}), g(lang, grp) AS (VALUES {GROUP_ROWS}), c(lang, base) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in T.LANGUAGE_COMPLEXITY.items())}), f(lang, factor) AS (VALUES {TIMES}), p(grp, own) AS (VALUES {PRIORITIES}),
d AS (SELECT coalesce(n_chars, 0)::BIGINT * 9 AS size, ([{', '.join(repr(e) for e in EXT)}])[doc_id % {len(EXT)} + 1] AS e FROM documents), x AS (SELECT lang, grp, size, coalesce(factor, 1.0)::DOUBLE AS factor, coalesce(base, 0.5)::DOUBLE AS base FROM d JOIN l USING (e) JOIN g USING (lang) LEFT JOIN c USING (lang) LEFT JOIN f USING (lang)),
y AS (SELECT *, CASE WHEN size > 204800 THEN least(1.0, base + 0.2) WHEN size > 102400 THEN least(1.0, base + 0.1) WHEN size < 10240 THEN greatest(0.1, base - 0.1) ELSE base END AS c FROM x),
z AS (SELECT grp, count(*)::BIGINT AS n, sum(size)::BIGINT AS total_size, avg(size) AS mean_size, avg(c) AS c, array_to_string(list_sort(list(DISTINCT lang)), ' ') AS languages, greatest(1.0, max(factor)) AS factor FROM y GROUP BY 1)
SELECT grp, n, total_size, mean_size, round(c, 6) AS complexity, languages, least(100, 50 + own + CASE WHEN round(c, 6) <= 0.3 THEN 20 WHEN round(c, 6) <= 0.7 THEN 10 ELSE 0 END + CASE WHEN mean_size <= 51200 THEN 15 WHEN mean_size <= 102400 THEN 5 ELSE 0 END)::INTEGER AS priority, round(total_size / 1024 * 10 * (1 + c) * factor)::BIGINT AS millis FROM z JOIN p USING (grp)""")
def file_groups(t):
    """Groups of files by language, most urgent first."""
    from ..sources.files import file_groups as grouped

    return grouped(_paths(t).select("path", (F.col("n_chars").cast("long") * 9).alias("size"))).withColumn("languages", F.array_join("languages", " "))


@query("""WITH d AS (SELECT CASE doc_id % 3 WHEN 0 THEN concat('/', source, '/a.py') WHEN 1 THEN concat(source, '/', lang, '/', doc_id % 4, '/x//', 'a.py') ELSE 'a.py' END AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
s AS (SELECT string_split(regexp_extract(regexp_replace(path, '/{2,}', '/', 'g'), '^(.*)/[^/]*$', 1), '/') AS p FROM d) SELECT array_to_string(CASE WHEN len(p) > 3 THEN p[-3:] ELSE p END, '/') AS dir, count(*)::BIGINT AS n FROM s GROUP BY 1""")
def group_by_directory(t):
    d = t("documents").where("source is not null and lang is not null")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), "source", F.lit("/a.py"))).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", "source", "lang", F.col("doc_id") % 4, F.lit("x//a.py"))).otherwise("a.py")
    return d.groupBy(T.last_directories(path).alias("dir")).agg(F.count("*").alias("n"))


def _has(q: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({q}, '{x}')" for x in terms) + ")"


# what is asked for: file queries of all kinds, made of the first words of the texts
ASKED = ["{0}.en", "find all {0} files", "files in directory {0} {1}", "find {0} related to {1}", "find .de", "files with extension .en", "search about {0} {1} {2}", "{0} {1}", "关于 {0} {1}", "在 {0} 目录下 {1}", "recent {0}_{1}.fr", "all {2}"]


def asked_sql(table: str, key: str) -> str:
    """``query_id, query`` of a table with texts."""
    parts = lambda x: " || ".join(f"'{p}'" if i % 2 == 0 else f"w[{int(p) + 1}]" for i, p in enumerate(re.split(r"[{}]", x)) if p)
    return f"SELECT {key} AS query_id, CASE {key} % {len(ASKED)} {' '.join(f'WHEN {i} THEN {parts(x)}' for i, x in enumerate(ASKED))} END AS query FROM (SELECT {key}, list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), ['one', 'two', 'three']) AS w FROM {table})"


def asked(rows, key: str):
    words = F.concat(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1)), F.array(*map(F.lit, ("one", "two", "three"))))
    made = lambda x: F.concat(*[F.lit(p) if i % 2 == 0 else F.get("w", F.lit(int(p))) for i, p in enumerate(re.split(r"[{}]", x)) if p])
    out = F
    for i, x in enumerate(ASKED):
        out = out.when(F.col(key) % len(ASKED) == i, made(x))
    return rows.withColumn("w", words).select(F.col(key).alias("query_id"), out.alias("query"))


INTENT_SQL = f"""d AS (SELECT query_id, query, lower(trim(query)) AS s FROM asked),
f AS (SELECT query_id, query, s, regexp_matches(s, '^[\\w-]+\\.\\w+$') OR NOT {_has('s', T.NO_NAME_TERMS)} AS ex, {_has('s', T.PATH_TERMS)} AND {_has('s', T.PLACE_TERMS)} AS pa,
{_has('s', T.SEMANTIC_TERMS)} OR ({_has('s', ['find', 'search'])} AND NOT {_has('s', ['typescript', 'files'])}) AS se,
regexp_matches(s, '\\.[a-zA-Z]+') OR regexp_matches(s, '\\.\\w+$') OR {_has('s', T.EXTENSION_TERMS)} OR (contains(s, 'files') AND NOT {_has('s', ['related', 'authentication'])}) AS xt FROM d),
intents AS (SELECT query_id, query, s, CASE WHEN ex THEN 'EXACT_FILENAME' WHEN xt AND contains(s, 'files') AND NOT pa THEN 'EXTENSION_SEARCH' WHEN pa AND NOT se AND {_has('s', T.NAMED_TERMS)} THEN 'PATH_PATTERN'
WHEN pa::INT + se::INT + xt::INT >= 2 THEN 'HYBRID_QUERY' WHEN xt THEN 'EXTENSION_SEARCH' WHEN pa THEN 'PATH_PATTERN' WHEN se THEN 'SEMANTIC_DESCRIPTION' ELSE 'HYBRID_QUERY' END AS intent FROM f)"""


@query(f"WITH c AS (SELECT conv_id * 100 + turn AS key, text FROM conversations), asked AS ({asked_sql('c', 'key')}), {INTENT_SQL} SELECT query_id, query, intent FROM intents")
def query_intent(t):
    q = asked(t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), "text"), "key")
    return q.select("query_id", "query", T.intent(F.col("query"))[0].alias("intent"))


@query("SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(p_brand || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\W]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS words FROM part")
def code_to_text(t):
    return t("part").select("p_partkey", T.code_to_text(F.concat("p_brand", "p_type")).alias("words"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def content_hashes(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query("""SELECT doc_id, 'chunk:' || source || ':1-' || n_chars || ':' || substr(md5(text), 1, 8) AS chunk, 'file:' || source || ':p' AS file, 'rel:' || substr(source, 1, 50) || '->' || substr(lang, 1, 50) || ':USES' AS rel FROM documents""")
def deterministic_ids(t):
    from .. import model as M

    return t("documents").select("doc_id", M.chunk_id(F.col("source"), F.lit(1), F.col("n_chars"), F.col("text")).alias("chunk"), M.file_id(F.col("source"), F.lit("p")).alias("file"), M.relation_id(F.col("source"), F.col("lang"), F.lit("USES")).alias("rel"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(id, other) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a)
SELECT id, min(other) AS "group" FROM r GROUP BY 1""")
def near_duplicate_groups(t):
    return S.near_duplicate_groups(t("documents"), "doc_id", "text")


@query()
def greedy_filter(t):
    return S.greedy_groups(t("benchmark"), "item_id", "text", 0.1)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents),
s AS (SELECT doc_id, CASE WHEN trim(x) = '' THEN 1.0 ELSE (length(x) + CASE WHEN regexp_matches(x, '\b(function|class|interface|const|let|var)\b') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(x, '\b(if|else|while|for|switch|case)\b') THEN 5 ELSE 0 END
+ CASE WHEN regexp_matches(x, '\b(import|export|require|from)\b') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(x, '\b(try|catch|finally|throw)\b') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(x, '\b(return|break|continue)\b') THEN 4 ELSE 0 END
+ len(regexp_extract_all(x, '[{}]')) * 3 + len(regexp_extract_all(x, '[()]')) * 2 + len(regexp_extract_all(x, '[\[\]]')) * 1.5) * CASE WHEN regexp_matches(x, '^\s*(//|/\*|\*)') THEN 0.3 ELSE 1.0 END END AS score FROM l)
SELECT doc_id, count(*) AS lines, round(sum(score), 4)::DOUBLE AS score, round(max(score), 4)::DOUBLE AS most FROM s GROUP BY 1""")
def semantic_lines(t):
    """How much the lines of every document say."""
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).withColumn("score", T.semantic_line_score(F.col("x")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.round(F.sum("score"), 4).alias("score"), F.round(F.max("score"), 4).alias("most"))


IGNORED = "# what is left out\n*.tmp\nen/\n!src1/en/\n\n/src3\n"


@query("""WITH p AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'x') || '/f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.tmp' ELSE '.md' END AS path FROM documents)
SELECT doc_id, path, CASE WHEN starts_with(path, 'src3/') THEN true WHEN starts_with(path, 'src1/en/') THEN false ELSE contains('/' || path, '/en/') OR ends_with(path, '.tmp') END AS ignored FROM p""")
def ignored_paths(t):
    """Paths by the rules of an ignore file, of which the last that matches decides."""
    from ..operators import predicates as P

    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("x")), F.lit("/f"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".tmp").otherwise(".md"))
    rows = t("documents").select("doc_id", path.alias("path"))
    return rows.withColumn("ignored", P.is_ignored(F.col("path"), P.ignore_rules(IGNORED)))
