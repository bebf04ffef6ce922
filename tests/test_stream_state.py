"""Histories, bursts and prioritised work of streams: a replayed stream gives the batch answer."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import changes as H
from lodestone.streaming import changes, state, work

T0 = datetime(2024, 1, 1)


def parts(spark, path, rows, schema, n):
    """Rows as ``n`` files, one a batch."""
    for i in range(n):
        spark.createDataFrame(rows[len(rows) * i // n : len(rows) * (i + 1) // n], schema).coalesce(1).write.mode("append").parquet(path)


def plain_bursts(times):
    out, held = [], []
    for t in sorted(times):
        n = len(held)
        gap = 100 if n >= 50 else 500 if n >= 20 else 1000 if n >= 10 else 500
        if held and t - held[-1] > timedelta(milliseconds=gap):
            out.append(held)
            held = []
        held.append(t)
    return [(h[0], h[-1], len(h)) for h in [*out, *([held] if held else [])]]


def bursty(seed, keys, n):
    r = random.Random(seed)
    rows = []
    for k in keys:
        t = T0
        for _ in range(n):
            t += timedelta(milliseconds=r.choice([0, 10, 50, 90, 150, 400, 700, 900, 3000] if r.random() < 0.1 else [0, 20, 60, 90]))
            rows.append((k, t))
    return rows


def test_dynamic_bursts_of_a_table(spark):
    rows = bursty(1, ["a", "b", None], 400) + [("a", None)]
    got = H.dynamic_bursts(spark.createDataFrame(rows, "k string, at timestamp"), "at", ["k"]).collect()
    want = [(k, *b) for k in ("a", "b", None) for b in plain_bursts([t for x, t in rows if x == k and t])]
    key = lambda x: (x[0] or "", *x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and any(b[3] >= 50 for b in want)
    assert [(a, b, n) for a, b, _, n in H.flushed([0, 500_000, 1_000_001])] == [(0, 500_000, 2), (1_000_001, 1_000_001, 1)]


def test_dynamic_bursts_of_a_stream(spark, tmp_path):
    rows = bursty(2, ["a", "b"], 300)
    rows = sorted(rows, key=lambda x: (x[1], x[0]))
    # out of order within the delay of the watermark
    r = random.Random(3)
    mixed = sorted(rows, key=lambda x: x[1] + timedelta(milliseconds=r.randint(0, 4000)))
    end = rows[-1][1] + timedelta(hours=1)
    parts(spark, str(tmp_path / "in"), [*mixed, ("z", end), ("z", end + timedelta(hours=1))], "k string, at timestamp", 4)
    source = changes.read(spark, str(tmp_path / "in"), "k string, at timestamp", 1)
    with state.rocks(spark):
        changes.run_to(state.dynamic_bursts(source, "at", "k", late="5 seconds"), str(tmp_path / "out"), str(tmp_path / "point"))
    got = spark.read.parquet(str(tmp_path / "out")).where("key <> 'z'").select("key", "start", "last", "n").collect()
    batch = H.dynamic_bursts(spark.createDataFrame(rows, "k string, at timestamp"), "at", ["k"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and len(batch) > 10


def test_histories(spark, tmp_path):
    r = random.Random(4)
    rows = [(f"f{r.randrange(6)}", f"h{i}", T0 + timedelta(seconds=i)) for i in range(120)] + [(None, "x", T0), ("f0", None, T0 + timedelta(seconds=500))]
    schema = "path string, hash string, at timestamp"
    parts(spark, str(tmp_path / "in"), rows, schema, 3)
    source = changes.read(spark, str(tmp_path / "in"), schema, 1)
    with state.rocks(spark):
        changes.run_each(state.histories(source, 5), changes.into_table(str(tmp_path / "t"), ["path"], "last"), str(tmp_path / "point"))
    got = {x["path"]: x["hashes"] for x in changes.table_at(spark, str(tmp_path / "t")).collect()}
    own = spark.createDataFrame(rows, schema).where("path is not null")
    batch = H.latest(own, ["path"], [F.desc("at")], 5).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("e")).collect()
    assert got == {x["path"]: [e["hash"] for e in x["e"]] for x in batch} and max(map(len, got.values())) == 5


def test_prioritised_work(spark, tmp_path):
    """A kind that fails comes again with the next batch, and is dead after the last try; a
    batch that breaks off goes on where it stopped and is done once."""
    at = str(tmp_path / "work")
    calls, bad = [], {"modified"}

    def handler(rows, kind, number):
        if kind == "crash":
            raise KeyboardInterrupt
        calls.append((number, kind, sorted(r["path"] for r in rows.collect())))
        if kind in bad:
            raise ValueError("no " + kind)

    each = work.prioritised(at, handler, tries=2)
    batch = lambda *x: spark.createDataFrame(list(x), "path string, kind string")
    each(batch(("a", "created"), ("b", "deleted"), ("c", "modified"), ("x", None), ("b2", "deleted")), 0)
    assert calls == [(0, "deleted", ["b", "b2"]), (0, "modified", ["c"]), (0, "created", ["a"]), (0, "other", ["x"])]
    assert [(r["path"], r["tries"], r["error"]) for r in work.waiting(spark, at).collect()] == [("c", 1, "ValueError: no modified")]
    calls.clear()
    each(batch(("a", "created"), ("b", "deleted")), 0)  # the same batch again
    assert calls == []
    each(batch(("d", "modified")), 1)
    assert calls == [(1, "modified", ["c", "d"])]
    schema = "path string, kind string, tries int, error string"
    assert [(r["path"], r["tries"]) for r in work.dead(spark, at, schema).collect()] == [("c", 2)]
    assert [(r["path"], r["tries"]) for r in work.waiting(spark, at).collect()] == [("d", 1)]
    calls.clear()
    bad.clear()

    # the driver goes down after the deletions of a batch
    def crashing(rows, kind, number):
        if kind == "modified":
            raise KeyboardInterrupt
        handler(rows, kind, number)

    rows = batch(("e", "deleted"), ("f", "created"))
    with pytest.raises(KeyboardInterrupt):
        work.prioritised(at, crashing, tries=2)(rows, 2)
    each(rows, 2)
    assert calls == [(2, "deleted", ["e"]), (2, "modified", ["d"]), (2, "created", ["f"])]
    assert work.waiting(spark, at).count() == 0


def test_prioritised_stream(spark, tmp_path):
    rows = [(f"p{i}", ["created", "modified", "deleted"][i % 3]) for i in range(30)]
    parts(spark, str(tmp_path / "in"), rows, "path string, kind string", 3)
    done = []
    each = work.prioritised(str(tmp_path / "work"), lambda r, kind, number: done.append((number, kind, r.count())))
    for _ in range(2):  # the second run has nothing new
        changes.run_each(changes.read(spark, str(tmp_path / "in"), "path string, kind string", 1), each, str(tmp_path / "point"))
    assert sorted(n for _, _, n in done) == [3, 3, 3, 3, 3, 3, 4, 4, 4] and [k for _, k, _ in done[:3]] == ["deleted", "modified", "created"]
