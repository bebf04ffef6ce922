"""Filters, joins, aggregates and metadata over plain tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import predicates as P
from .base import Catalog

C = Catalog()
query = C.query


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 AND c_acctbal < 5000")
def filter_in_and_range(t):
    df = t("customer")
    return df.where(P.matches(df, {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_acctbal": {"gte": 0, "lt": 5000}})).select("c_custkey", "c_name")


@query("SELECT doc_id FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents) WHERE list_has_any(w, ['the', 'une'])")
def filter_array_any(t):
    df = t("documents").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    return df.where(P.matches(df, {"w": ["the", "une"]})).select("doc_id")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT IN (1, 5, 76)")
def filter_nested_key(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").select("event_id", k.alias("k")).where(F.col("k").isin(1, 5, 76))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice > 100000 OR o_orderpriority = '1-URGENT') AND NOT (o_custkey % 2 = 0)")
def filter_boolean(t):
    return t("orders").where(P.boolean([F.col("o_orderstatus") == "O"], [F.col("o_totalprice") > 100000, F.col("o_orderpriority") == "1-URGENT"], [F.col("o_custkey") % 2 == 0])).select("o_orderkey")


@query("SELECT r_regionkey, r_name FROM region")
def filter_none(t):
    return t("region").where(P.matches(t("region"), {})).select("r_regionkey", "r_name")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(p_name, 'a') ORDER BY p_partkey LIMIT 100")
def node_name_contains(t):
    return t("part").where(F.col("p_name").contains("a")).orderBy("p_partkey").limit(100).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'e') OR contains(p_type, 'E') ORDER BY 1 LIMIT 10")
def typed_node_search(t):
    return t("part").where(F.col("p_name").contains("e") | F.col("p_type").contains("E")).orderBy("p_partkey").limit(10).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(p_name, '1') OR contains(p_brand, '1') OR contains(p_type, '1')")
def any_field_search(t):
    df = t("part")
    strings = [F.col(c) for c, kind in df.dtypes if kind == "string"]
    return df.where(P.boolean(should=[c.contains("1") for c in strings])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND p_size = 10 ORDER BY 1 LIMIT 100")
def property_lookup(t):
    df = t("part")
    return df.where(P.matches(df, {"p_brand": "Brand#12", "p_size": 10})).orderBy("p_partkey").limit(100).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') OR contains(lower(source), 'src1') ORDER BY doc_id LIMIT 10")
def keyword_search(t):
    return t("documents").where(F.lower("text").contains("the") | F.lower("source").contains("src1")).orderBy("doc_id").limit(10).select("doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '1') AND c_mktsegment = 'BUILDING' ORDER BY lower(c_name) DESC, c_custkey LIMIT 20 OFFSET 20")
def project_list(t):
    df = t("customer").where(F.lower("c_name").contains("1") & (F.col("c_mktsegment") == "BUILDING"))
    return P.page(df, [F.lower("c_name").desc(), "c_custkey"], 20, 20).select("c_custkey", "c_name")


@query("SELECT event_id, ts FROM events WHERE event_type IN ('error', 'click') AND value > 10 AND ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) ORDER BY ts DESC, event_id LIMIT 50")
def error_log_filter(t):
    e = t("events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    return e.where(F.col("event_type").isin("error", "click") & (F.col("value") > 10) & (F.col("ts") >= F.lit(low + (high - low) / 2))).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts")


ERRORS = {"id": "event_id", "level": "CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' ELSE 'high' END", "category": "event_type", "resolved": "user_id % 2 = 0", "at": "ts"}


@query(f"""WITH e AS (SELECT {', '.join(f'{x} AS "{k}"' for k, x in ERRORS.items())}, [event_type, concat('k', (props->>'$.k')::BIGINT % 7), concat('u', user_id % 5)] AS tags FROM events)
SELECT id, level, "at" FROM e WHERE level = 'high' AND category = 'error' AND list_has_any(tags, ['k3', 'u2']) AND NOT resolved AND "at" >= (SELECT min(ts) + (max(ts) - min(ts)) / 4 FROM events)""")
def error_log(t):
    from ..operators.metrics import error_log as found

    e = t("events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    tags = F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("long") % 7), F.concat(F.lit("u"), F.col("user_id") % 5))
    rows = e.select(*[F.expr(x).alias(k) for k, x in ERRORS.items()], tags.alias("tags"))
    return found(rows, "high", "error", ["k3", "u2"], False, low + (high - low) / 4 if low else None).select("id", "level", "at")


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS ids FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def ids_by_file(t):
    return t("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))


@query("SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 100 OFFSET 200")
def scroll_points(t):
    return P.page(t("embeddings").select("vec_id"), ["vec_id"], 200, 100)


@query("SELECT url FROM pages WHERE regexp_matches(url, '^https://[^/]*/.*$') AND NOT regexp_matches(url, '^.*[?].*$')")
def glob_match(t):
    u = F.col("url")
    return t("pages").where(u.rlike(P.glob_regex("https://*/**")) & ~u.rlike(P.glob_regex("**") .replace(".*", ".*[?].*"))).select("url")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def inner_join(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def existing_ids(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def delete_points(t):
    e = t("embeddings").select("vec_id")
    return e.join(t("labels"), e["vec_id"] == F.col("doc_id"), "left_anti")


@query("""WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(upper(text)) ELSE md5(text) END AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'modified' ELSE 'unchanged' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def detect_changes(t):
    from ..operators.changes import compare

    d = t("documents")
    old = d.where("doc_id % 3 <> 0").select("doc_id", F.md5("text").alias("hash"))
    new = d.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.md5(F.upper("text"))).otherwise(F.md5("text")).alias("hash"))
    return compare(old, new, "doc_id").select("doc_id", "change")


@query("""SELECT coalesce(v.vec_id, d.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'missing_graph' ELSE 'missing_vector' END AS kind, 'high' AS severity
FROM embeddings v FULL JOIN documents d ON v.vec_id = d.doc_id WHERE v.vec_id IS NULL OR d.doc_id IS NULL""")
def consistency(t):
    v, d = t("embeddings").select("vec_id"), t("documents").select("doc_id")
    both = v.join(d, F.col("vec_id") == F.col("doc_id"), "full_outer").where("vec_id is null or doc_id is null")
    return both.select(F.coalesce("vec_id", "doc_id").alias("id"), F.when(F.col("doc_id").isNull(), "missing_graph").otherwise("missing_vector").alias("kind"), F.lit("high").alias("severity"))


@query("""WITH u AS (SELECT doc_id, source, 0 AS p FROM documents WHERE contains(text, 'the') UNION ALL SELECT doc_id, source, 1 AS p FROM documents WHERE lang = 'en')
SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, doc_id) AS n FROM u) WHERE n = 1""")
def merge_results(t):
    d = t("documents")
    found = d.where(F.col("text").contains("the")).select("doc_id", "source", F.lit(0).alias("p")).unionByName(d.where("lang = 'en'").select("doc_id", "source", F.lit(1).alias("p")))
    return found.groupBy("source").agg(F.min_by("doc_id", F.struct("p", "doc_id")).alias("doc_id"))


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def count_by_type(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*)::BIGINT AS total, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done FROM orders GROUP BY 1")
def files_by_status(t):
    is_ = lambda s: F.sum((F.col("o_orderstatus") == s).cast("int"))
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("total"), is_("O").alias("open"), is_("F").alias("done"))


@query("SELECT count(*)::BIGINT AS total, sum(CASE WHEN (props->>'$.k')::BIGINT > 50 THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN (props->>'$.k')::BIGINT <= 50 THEN 1 ELSE 0 END)::BIGINT AS low FROM events")
def state_stats(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").agg(F.count("*").alias("total"), F.sum((k > 50).cast("int")).alias("high"), F.sum((k <= 50).cast("int")).alias("low"))


TABLES = ["region", "nation", "customer", "supplier", "part", "orders"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::BIGINT AS n FROM {n}" for n in TABLES))
def table_counts(t):
    parts = [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n)::BIGINT AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most,
max(CASE WHEN i = floor(n * 0.95) THEN value END) AS p95, max(CASE WHEN i = floor(n * 0.99) THEN value END) AS p99 FROM s GROUP BY 1""")
def metrics_summary(t):
    from ..operators.metrics import summary

    return summary(t("events"), "event_type", "value")


@query("""SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS running FROM events""")
def running_average(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("user_id", "event_id", F.round(F.avg("value").over(w), 9).alias("running"))


@query("""WITH k(event_type) AS (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error'), ('crash'))
SELECT k.event_type, coalesce(n, 0)::BIGINT AS n FROM k LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type) ORDER BY n DESC LIMIT 10""")
def error_statistics(t):
    from ..operators.metrics import counts_of_all

    return counts_of_all(t("events"), "event_type", ["view", "click", "purchase", "signup", "error", "crash"])


@query("""WITH m AS (SELECT max(ts) AS now FROM events)
SELECT event_type, count(*) / 60.0::DOUBLE AS per_second, round(avg(value), 4) AS mean, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS share
FROM events, m WHERE ts > now - INTERVAL 1 DAY GROUP BY 1""")
def dashboard(t):
    from ..operators.metrics import recent

    return recent(t("events"), "ts", "event_type", "value", "1 day", F.col("value") > 50)


@query("""WITH x AS (SELECT event_type, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM events GROUP BY 1)
SELECT event_type, round(CASE WHEN a = 0 THEN 0 ELSE (b - a) / a END, 6) AS change,
CASE WHEN a = 0 THEN 'stable' WHEN (b - a) / a > 0.1 THEN 'increasing' WHEN (b - a) / a < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM x""")
def trend(t):
    from ..operators.metrics import trend as trend_

    return trend_(t("events"), "event_type", "value", ["ts", "event_id"])


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*)::BIGINT AS n, round(avg(value), 4) AS mean, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2""")
def metric_history(t):
    from ..operators.metrics import history

    return history(t("events"), "ts", "event_type", "value", "1 hour").withColumnRenamed("start", "hour")


@query("SELECT event_id, CASE WHEN value > 90 THEN 'critical' WHEN value > 60 THEN 'high' ELSE 'medium' END AS severity FROM events WHERE value > 30")
def alerts(t):
    from ..operators.metrics import severity

    return t("events").select("event_id", severity(F.col("value"), 30, (2, 3)).alias("severity")).where("severity is not null")


@query("SELECT DISTINCT md5(text) AS h, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id FROM documents")
def distinct_contents(t):
    return t("documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("first_id"))


@query("SELECT DISTINCT source FROM documents")
def distinct_paths(t):
    return t("documents").select("source").distinct()


@query("""SELECT CASE WHEN n_chars <= 1000 THEN 'small' WHEN n_chars <= 5000 THEN 'medium' ELSE 'large' END AS size, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""")
def group_by_size(t):
    size = F.when(F.col("n_chars") <= 1000, "small").when(F.col("n_chars") <= 5000, "medium").otherwise("large")
    return t("documents").groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def largest_files(t):
    return t("documents").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


@query("SELECT doc_id, round(n_chars / 1000.0, 2) AS score FROM documents ORDER BY round(n_chars / 1000.0, 2) DESC, doc_id LIMIT 25")
def file_result_sort(t):
    score = F.round(F.col("n_chars") / 1000.0, 2)
    return t("documents").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def latest_per_file(t):
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 999 END AS priority FROM events ORDER BY 2, 1 LIMIT 100""")
def change_priority(t):
    from ..operators.changes import priority

    p = priority(F.col("event_type"), ["view", "click", "purchase"])
    return t("events").select("event_id", p.alias("priority")).orderBy("priority", "event_id").limit(100)


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def bounded_history(t):
    from ..operators.changes import latest

    return latest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "ts")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY AND o_orderstatus = 'P'")
def expired_hashes(t):
    o = t("orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    return o.join(F.broadcast(last)).where("o_orderdate < last - interval 30 days and o_orderstatus = 'P'").select("o_orderkey")  # a single row


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""")
def debounced_changes(t):
    from ..operators.changes import debounce

    return debounce(t("events"), "ts", ["user_id"], "1 hour").select("user_id", "start", "n")


@query("SELECT vec_id % 4 AS collection, count(*)::BIGINT AS points, max(len(embedding))::BIGINT AS size FROM embeddings GROUP BY 1")
def collection_info(t):
    return t("embeddings").groupBy((F.col("vec_id") % 4).alias("collection")).agg(F.count("*").alias("points"), F.max(F.size("embedding")).cast("long").alias("size"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def update_nodes(t):
    from ..operators.graph import upsert

    c = t("customer").select("c_custkey", "c_acctbal")
    return upsert(c, c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


PLACED = {"project_id": "o_custkey % 40", "path": "concat('f', o_orderkey % 5000)", "hash": "md5(o_orderpriority)", "at": "o_orderdate"}
STATES = 'SELECT project_id, path, arg_max(hash, ("at", hash)) AS hash FROM (SELECT {} FROM orders) GROUP BY 1, 2'.format(", ".join(f'{x} AS "{k}"' for k, x in PLACED.items()))


@query(f"""WITH s AS ({STATES}), r AS (SELECT o_custkey % 40 AS p, concat('f', o_orderkey % 5000) AS old, arg_max(concat('f', o_orderkey % 5000 + 1 + o_custkey % 3), (o_orderdate, concat('f', o_orderkey % 5000 + 1 + o_custkey % 3))) AS new FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2),
m AS (SELECT s.*, r.old, coalesce(r.new, path) AS target FROM s LEFT JOIN r ON r.p = project_id AND r.old = path), w AS (SELECT *, min(old) OVER (PARTITION BY project_id, target) AS first FROM m) SELECT project_id, target AS path, hash FROM w WHERE first IS NULL OR old = first""")
def renamed_files(t):
    """States of files after renames that swap, follow and cover one another."""
    from ..operators.changes import renamed

    o = t("orders")
    states = o.select(*[F.expr(x).alias(k) for k, x in PLACED.items()]).groupBy("project_id", "path").agg(F.max_by("hash", F.struct("at", "hash")).alias("hash"))
    new = F.concat(F.lit("f"), F.col("o_orderkey") % 5000 + 1 + F.col("o_custkey") % 3)
    moves = o.where("o_orderstatus = 'P'").select((F.col("o_custkey") % 40).alias("project_id"), F.concat(F.lit("f"), F.col("o_orderkey") % 5000).alias("old"), new.alias("new"), F.col("o_orderdate").alias("at"))
    return renamed(states, moves)


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c))
SELECT 'customer' AS name, count(*)::BIGINT AS n FROM customer WHERE c_custkey NOT IN (FROM c) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (FROM o) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM o)""")
def cascade_delete(t):
    """Rows that are left when projects go with their files and what belongs to those."""
    from ..operators.changes import delete_cascading

    tables = {name: t(name) for name in ("customer", "orders", "lineitem")}
    gone = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    left = delete_cascading(tables, gone, "customer", [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")])
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("SELECT regexp_matches(url, '^https://[^/]*/[a-m]') AS matched, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def changes_by_pattern(t):
    from ..operators.changes import by_pattern

    return by_pattern(t("pages"), "url", "^https://[^/]*/[a-m]").groupBy("matched").agg(F.count("*").alias("n"))
