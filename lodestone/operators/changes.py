"""Change processing over tables of file states and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, scan

# fixed values: file extensions that each index reads
GRAPH_EXTENSIONS = ["ts", "js", "tsx", "jsx", "py", "java", "cpp", "c", "h", "hpp"]
VECTOR_EXTENSIONS = [*GRAPH_EXTENSIONS, "md", "txt"]


def compare(old: DataFrame, new: DataFrame, key: str, value: str = "hash") -> DataFrame:
    """added, deleted, modified or unchanged for every key of either table."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), new.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def priority(kind: Column, order: list[str]) -> Column:
    out = F.lit(999)
    for i, k in reversed(list(enumerate(order, 1))):
        out = F.when(kind == k, i).otherwise(out)
    return out


def routed(changes: DataFrame, extension: Column) -> DataFrame:
    return changes.withColumn("to_vector", extension.isin(VECTOR_EXTENSIONS)).withColumn("to_graph", extension.isin(GRAPH_EXTENSIONS))


def by_pattern(changes: DataFrame, path_col: str, pattern: str) -> DataFrame:
    """Adds ``matched``: whether a path holds the pattern; a null path does not."""
    return changes.withColumn("matched", F.coalesce(F.col(path_col).rlike(pattern), F.lit(False)))


def renamed(states: DataFrame, renames: DataFrame, project: str = "project_id", path: str = "path") -> DataFrame:
    """File states after ``renames`` (``project, old, new, at``), all at once: states of the
    old path go on under the new one, what stood there goes, paths that nobody has are
    passed over. Of several renames of a path the last counts, of equally late ones the one
    with the larger name; renames from or to null go. Of states that come to stand under
    one name, only the moved ones stay; if several moved there, the one of the smallest old
    path; a repeated state of one path stays repeated."""
    fine = renames.where("old is not null and new is not null").groupBy(F.col(project).alias("_p"), F.col("old").alias("_old")).agg(F.max_by("new", F.struct("at", "new")).alias("_new"))
    moved = states.join(fine, F.col(project).eqNullSafe(F.col("_p")) & (F.col(path) == F.col("_old")), "left").drop("_p")
    target = F.coalesce("_new", path)
    w = Window.partitionBy(project, target)
    told = moved.withColumn("_least", F.min("_old").over(w)).where((F.col("_old") == F.col("_least")) | F.col("_least").isNull())
    return told.withColumn(path, F.coalesce("_new", path)).select(states.columns)


def delete_cascading(tables: dict[str, DataFrame], gone: DataFrame, first: str, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """What is left of all tables when the rows of ``first`` that ``gone`` names (by its own
    columns) go and, link by link (child, its column, parent, the parent's column), the
    rows that belong to rows that went. Links come parents first; rows that belong to
    nothing (null) stay."""
    went = {first: tables[first].join(gone.distinct(), gone.columns, "left_semi")}
    left = {**tables, first: tables[first].join(gone.distinct(), gone.columns, "left_anti").select(tables[first].columns)}
    for child, key, parent, own in links:
        if parent not in went:
            raise ValueError(f"{parent} is deleted from by no link before that of {child}")
        keys = went[parent].select(F.col(own).alias(key)).where(F.col(key).isNotNull()).distinct()
        more = tables[child].join(keys, key, "left_semi").select(tables[child].columns)
        went[child] = went[child].unionByName(more) if child in went else more
        left[child] = left[child].join(keys, key, "left_anti").select(tables[child].columns)
    return left


def latest(events: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key; the limit holds in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def debounce(events: DataFrame, time: str, keys: list[str], gap: str) -> DataFrame:
    """Bursts of events of a key with less than ``gap`` between neighbours."""
    burst = events.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return burst.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


# fixed values: from so many waiting changes on, so many ms without one flush them; else 500
GAPS = [(50, 100), (20, 500), (10, 1000)]
GAP = 500


def gap_for(pending: Column) -> Column:
    """Milliseconds to wait by how many changes are pending."""
    out = F
    for least, ms in GAPS:
        out = out.when(pending >= least, ms)
    return out.otherwise(GAP)


def flushed(times: list[int], stretch: float = 1.0) -> list[tuple[int, int, int, int]]:
    """``first, last, end, number`` of bursts of sorted times in microseconds. A burst ends
    when its gap has passed since its last change; one just then still belongs to it."""
    out: list[tuple[int, int, int, int]] = []
    for t in times:
        first, n = (out[-1][0], out[-1][3]) if out and t <= out[-1][2] else (t, 0)
        if n:
            out.pop()
        gap = next((ms for least, ms in GAPS if n + 1 >= least), GAP)
        out.append((first, t, t + int(1000 * gap * stretch), n + 1))
    return out


def dynamic_bursts(events: DataFrame, time: str, keys: list[str], stretch: float = 1.0) -> DataFrame:
    """``keys, start, last, n``: bursts of changes of a key whose gap depends on how many
    wait already. Events further apart than the longest gap part bursts in any case, by a
    window; a fold over the times in between finds the other ends."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    order = Window.partitionBy(*keys).orderBy("_us")
    longest = int(1000 * stretch * max(GAP, *(ms for _, ms in GAPS)))
    rows = events.where(F.col(time).isNotNull()).select(*keys, us.alias("_us"))
    parted = rows.withColumn("_new", F.coalesce(F.col("_us") - F.lag("_us").over(order) > longest, F.lit(True)).cast("int"))
    part = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = parted.withColumn("_part", part).groupBy(*keys, "_part").agg(F.sort_array(F.collect_list("_us")).alias("_t"))

    def step(s: Column, t: Column) -> Column:
        def put(n: Column) -> Column:
            return F.struct((s["burst"] + (n == 1).cast("int")).alias("burst"), n.alias("n"), (t + (gap_for(n) * 1000 * stretch).cast("long")).alias("end"))

        return let(F.when(t <= s["end"], s["n"] + 1).otherwise(1), put)

    begin = F.struct(F.lit(0).alias("burst"), F.lit(0).alias("n"), F.lit(-(1 << 62)).alias("end"))
    numbers = scan(F.col("_t"), begin, step, lambda s: s["burst"], "int")
    each = held.select(*keys, "_part", F.explode(F.arrays_zip(F.col("_t").alias("t"), numbers.alias("b"))).alias("x"))
    found = each.groupBy(*keys, "_part", "x.b").agg(F.min("x.t").alias("start"), F.max("x.t").alias("last"), F.count("*").cast("int").alias("n"))
    return found.select(*keys, F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "n")


def flush_delay(waiting: Column) -> Column:
    """Milliseconds until waiting changes are worked on: the more there are, the sooner."""
    # fixed values: numbers of changes and delays
    return F.when(waiting >= 50, 100).when(waiting >= 20, 1000).otherwise(5000)


def live_entries(entries: DataFrame, cache: str, key: str, at: str, now: Column, ttl: str, most: int) -> DataFrame:
    """What a cache with a time to live and a most number of entries still holds: the last
    write of each key, if it is young enough and among the ``most`` newest."""
    last = entries.groupBy(cache, key).agg(F.max(at).alias(at)).where(F.col(at) > now - F.expr(f"interval {ttl}"))
    rank = F.row_number().over(Window.partitionBy(cache).orderBy(F.desc(at), key))
    return last.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def migrate_json(states: DataFrame, text_col: str, schema: str, key: str) -> DataFrame:
    """Rows of states that were kept as JSON texts; texts that are no JSON, or that lack
    the key, go."""
    rows = states.select(F.from_json(text_col, schema).alias("s")).select("s.*")
    return rows.where(F.col(key).isNotNull())
