"""Chunking, embedded code, code entities and change streams over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as K
from ..operators import entities as E
from ..operators import vector as V
from ..plans.lineage import shared_dir
from ..streaming import changes as S
from .base import Catalog

C = Catalog()
query = C.query
LINES = "SELECT {0}, string_split({1}, chr(10)) AS l FROM {2} WHERE {1} IS NOT NULL"
NOT_BLANK = "trim(translate(content, chr(10) || chr(13) || chr(9), '   ')) <> ''"


def summary(rows, key: str):
    return rows.select(key, F.col("chunk").cast("long").alias("chunk"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("content").alias("digest"))


@query(f"""WITH l AS ({LINES.format('doc_id', 'text', 'documents')}), c AS (SELECT doc_id, unnest(range(0, (len(l) + 3) // 4)) AS chunk, l FROM l),
t AS (SELECT doc_id, chunk, 4 * chunk + 1 AS start_line, least(4 * chunk + 4, len(l)) AS end_line, array_to_string(l[4 * chunk + 1:least(4 * chunk + 4, len(l))], chr(10)) AS content FROM c)
SELECT doc_id, chunk, start_line, end_line::BIGINT AS end_line, md5(content) AS digest FROM t WHERE {NOT_BLANK}""")
def fixed_chunks(t):
    return summary(K.chunks(t("documents"), K.fixed_ends(F.col("text"), 4)), "doc_id")


@query()
def line_chunks(t):
    return summary(K.chunks(t("documents"), K.line_ends(F.col("text"))), "doc_id")


@query()
def markdown_chunks(t):
    return summary(K.chunks(t("documents"), K.markdown_ends(F.col("text"))), "doc_id")


@query()
def bracket_chunks(t):
    return summary(K.chunks(t("pages"), K.bracket_ends(F.col("html")), "html", ("page_id",)), "page_id")


@query()
def xml_chunks(t):
    return summary(K.chunks(t("pages"), K.xml_ends(F.col("html")), "html", ("page_id",)), "page_id")


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 900)) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, b // 900 AS chunk, md5(substr(text, b + 1, 1000)) AS digest FROM w""")
def char_window_chunks(t):
    return t("documents").where("text is not null").select("doc_id", F.posexplode(K.char_windows(F.col("text"), 1000, 100)).alias("chunk", "c")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("c").alias("digest"))


@query()
def processed_chunks(t):
    """Line chunks, deduplicated, small ones joined, with overlap."""
    rows = K.dedup(K.chunks(t("documents"), K.line_ends(F.col("text"), 10, 400)), T.content_hash(F.col("content")))
    return summary(K.with_overlap(K.rebalance_last(K.filter_small(rows))), "doc_id")


@query()
def merged_chunks(t):
    rows = K.chunks(t("documents"), K.line_ends(F.col("text"), 10, 400))
    return summary(K.merge_neighbours(rows, words=T.keywords), "doc_id")


@query("""WITH s AS (SELECT page_id, 'script' AS kind, regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script\\s*>') AS b FROM pages UNION ALL SELECT page_id, 'style', regexp_extract_all(html, '(?is)<style\\b[^>]*>.*?</style\\s*>') FROM pages),
u AS (SELECT page_id, kind, unnest(range(0, len(b))) AS i, b FROM s) SELECT page_id, kind, i AS block, md5(regexp_extract(b[i + 1], '(?is)^<[^>]*>(.*)</[^>]*>$', 1)) AS digest FROM u""")
def embedded_code(t):
    return K.embedded(t("pages")).select("page_id", "kind", F.col("block").cast("long").alias("block"), F.md5("code").alias("digest"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line FROM pages)
SELECT page_id, line, regexp_extract(x, '^\\s*(?:const|let|var)\\s+([A-Za-z_]\\w*)', 1) AS name FROM l WHERE regexp_matches(x, '^\\s*(?:const|let|var)\\s+([A-Za-z_]\\w*)')""")
def code_variables(t):
    pages = t("pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return E.entities(pages).where("type = 'variable'").select(F.col("path").cast("long").alias("page_id"), F.col("line").cast("long").alias("line"), "name")


@query()
def code_graph(t):
    nodes, edges = E.to_graph(t("pages").select("url", "html"), path_col="url", text_col="html")
    return nodes.select("id", "type", "name").unionByName(edges.select(F.col("src").alias("id"), "type", F.col("dst").alias("name")))


def _folder(t) -> str:
    """A new folder where driver and executors reach it."""
    return f"{shared_dir(t('region').sparkSession)}/stream-{uuid.uuid4().hex}"


def _stream(t, key: str = "event_id"):
    """The events as a stream: written anew, as a stream reads folders."""
    at = _folder(t)
    events = t("events").select(key, F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.write.parquet(f"{at}/in")
    return at, S.read(events.sparkSession, f"{at}/in", events.schema)


@query("""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def stream_windows(t):
    at, events = _stream(t)
    S.run_each(S.measured(events, "ts", ["event_type"], "value", "1 day"), S.into_table(f"{at}/out", ["event_type", "start"], "n"), f"{at}/point")
    return S.table_at(t("events").sparkSession, f"{at}/out").withColumn("mean", F.round("mean", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def stream_file_changes(t):
    at, events = _stream(t)
    raw = events.select(F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("change").alias("kind"), F.md5(F.round("value", 0).cast("string")).alias("hash"), F.col("ts").alias("at"))
    S.run_to(S.file_changes(raw), f"{at}/out", f"{at}/point")
    return t("events").sparkSession.read.parquet(f"{at}/out")


@query()
def knn_approximate(t):
    """Ten nearest of every id divisible by 50, from the nearest cells."""
    points = t("embeddings")
    asked = points.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.approximate_search(points, asked).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


GAPPED = "CASE WHEN n >= 50 THEN 100 WHEN n >= 20 THEN 500 WHEN n >= 10 THEN 1000 ELSE 500 END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE ts IS NOT NULL),
r AS (SELECT user_id, k, us, us AS first, 1 AS n FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.us, CASE WHEN e.us - r.us <= {GAPPED} * 1000 * 43200::BIGINT THEN r.first ELSE e.us END, CASE WHEN e.us - r.us <= {GAPPED} * 1000 * 43200::BIGINT THEN r.n + 1 ELSE 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, make_timestamp(first) AS start, make_timestamp(max(us)) AS last, count(*)::INTEGER AS n FROM r GROUP BY user_id, first""")
def dynamic_bursts(t):
    """Bursts of a user's events; a gap of half a second stands for six hours."""
    from ..operators import changes as H

    found = H.dynamic_bursts(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], 43200.0)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")})


@query("""WITH r AS (SELECT user_id::VARCHAR AS path, md5(user_id::VARCHAR || event_type) AS hash, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, md5(user_id::VARCHAR || event_type) DESC) AS k FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)
SELECT path, count(*)::INTEGER AS n, string_agg(hash, ' ' ORDER BY k DESC) AS hashes, max(ts)::TIMESTAMP AS last FROM r WHERE k <= 5 GROUP BY path""")
def stream_histories(t):
    """The last five hashes of every user, kept as state of a stream."""
    from ..streaming import state

    at, events = _stream(t)
    raw = events.where("user_id is not null").select(F.col("user_id").cast("string").alias("path"), F.md5(F.concat(F.col("user_id").cast("string"), "event_type")).alias("hash"), F.col("ts").alias("at"))
    with state.rocks(t("events").sparkSession):
        S.run_each(state.histories(raw, 5), S.into_table(f"{at}/out", ["path"], "last"), f"{at}/point")
    rows = S.table_at(t("events").sparkSession, f"{at}/out")
    return rows.select("path", "n", F.array_join("hashes", " ").alias("hashes"), F.col("last").cast("timestamp_ntz").alias("last"))
