"""Vector searches against brute force; WARC round trips."""

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lodestone.llm import hilbert, saat, warc


def vectors(spark, n, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[5] = x[6] = x[7] = x[100]  # ties
    rows = [(i, v.tolist(), "z", 1) for i, v in enumerate(x)]
    odd = [(200, None), (300, [math.nan] * d), (301, [None] + [1.0] * (d - 1)), (302, [math.inf] + [0.0] * (d - 1)), (303, [0.0] * d), (304, [1.0])]
    rows = [r for r in rows if r[0] not in dict(odd)] + [(i, v, "z", 1) for i, v in odd]
    return spark.createDataFrame(rows + [rows[0]], "vec_id long, embedding array<float>, g string, rank int"), {r[0]: np.float64(r[1]) for r in rows if r[0] not in dict(odd)}, d


def test_top_inner_is_exact(spark):
    df, x, d = vectors(spark, 700)
    x[303] = np.zeros(d)
    x = {i: np.floor(v * 1024).astype(np.int64) for i, v in x.items()}
    want = []
    for q in x:
        if q % 100 == 0:
            best = sorted(((-int(v @ x[q]), i) for i, v in x.items() if i != q))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, saat.top_inner(df).collect())) == sorted(want)


def test_nearest_small_is_exact_and_large_has_recall(spark):
    df, x, _ = vectors(spark, 700)
    for options, least in (({}, 1.0), ({"window": 25}, 0.9)):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in hilbert.nearest(df, **options).collect()}
        hit = total = 0
        for q in x:
            if q % 100 == 0:
                best = sorted((math.sqrt(float(((v - x[q]) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]
                mine = [got[q, k + 1] for k in range(10)]
                assert all(abs(s - math.sqrt(float(((x[i] - x[q]) ** 2).sum()))) < 1e-12 for i, s in mine)
                hit += len({i for _, i in best} & {i for i, _ in mine})
                total += 10
                if least == 1.0:
                    assert [i for i, _ in mine] == [i for _, i in best]
        assert hit >= least * total


def test_nearest_has_recall_on_many_vectors(spark, tmp_path):
    """50,000 vectors without any structure, the hardest case; a query looks at 33,600 rows
    of 24 orderings, many of them the same."""
    rng = np.random.default_rng(7)
    n, d = 50_000, 64
    x = rng.standard_normal((n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), d).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    got = hilbert.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), every=500).toPandas()
    wide, hit = x.astype(np.float64), 0
    for q in range(0, n, 500):
        far = ((wide - wide[q]) ** 2).sum(1)
        far[q] = np.inf
        hit += len(set(np.argsort(far)[:10].tolist()) & set(got["vec_id"][got["query_id"] == q].tolist()))
    assert len(got) == 10 * (n // 500) and hit >= 0.9 * len(got)


def test_copies_and_equal_distances_are_exact(spark):
    """A hot vector with thousands of copies, also as queries, and points at one distance:
    neighbours go by distance and id, however small the window."""
    rng = np.random.default_rng(3)
    hot, ring = np.ones(8), np.eye(8)
    rows = [(i, hot.tolist()) for i in range(6000)] + [(6000 + i, (hot + 2 * ring[i % 8] * (-1) ** (i // 8)).tolist()) for i in range(16)] + [(7000 + i, (9 + rng.standard_normal(8)).tolist()) for i in range(300)]
    got = {}
    for r in hilbert.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {q: [i for i in range(11) if i != q][:10] for q in range(0, 6000, 100)}
    assert all([i for _, i, _ in sorted(got[q])] == want[q] and all(s == 0.0 for _, _, s in got[q]) for q in want)
    # the one query of the ring is nearest to the copies, of which the smallest ids count
    assert [(i, s) for _, i, s in sorted(got[6000])] == [(i, 2.0) for i in range(10)]
    assert set(got) == {*want, 6000, *range(7000, 7300, 100)} and all(len(x) == 10 for x in got.values())


def test_many_lengths(spark):
    rows = [(100 * n + i, [1.0 + i] * n) for n in range(1, 71) for i in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r["query_id"], r["vec_id"]) for r in saat.top_inner(df.where("size(embedding) % 10 = 1")).collect()} == {(100 * n, 100 * n + 1) for n in range(1, 71, 10)}


def test_searches_of_several_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 1, "a"), (1, [0.5, 0.5], 1, "a"), (2, [3.0, 4.0], 1, "a"), (100, [1.0, 2.0, 3.0], 1, "a"), (3, [1.0, 2.0, 4.0], 1, "a"), (1, [9.0, 9.0], 1, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, query_id string")
    near = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in hilbert.nearest(df).collect())
    assert near == [(0, 1, 1), (0, 2, 2), (100, 1, 3)]
    top = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in saat.top_inner(df).collect())
    assert top == [(0, 1, 2, 3 << 20), (0, 2, 1, 1 << 19), (100, 1, 3, 17 << 20)]


def test_vector_searches_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert hilbert.nearest(none).collect() == [] and saat.top_inner(none).collect() == []
    one = spark.createDataFrame([(100, [1.0, 0.5])], "vec_id long, embedding array<float>")
    assert hilbert.nearest(one).collect() == [] and saat.top_inner(one).collect() == []


def test_warc_round_trip(spark):
    pages = ["<html>é</html>", None, "", "a\r\n\r\nWARC/1.1\r\nb", "a\r\n\r\nWARC/1.1\r\nb", "x" * 100_000, "<html>é</html>", "\r\n\r\n", "y" * 2_500_000]
    df = spark.createDataFrame([(i, f"http://h{i}/p?q={i}" if i else None, t, 7) for i, t in enumerate(pages)], "page_id long, url string, html string, bytes int")
    rows = {r["page_id"]: r for r in warc.round_trip(df, with_payload=True).collect()}
    assert len(rows) == len(pages)
    for i, t in enumerate(pages):
        raw = (t or "").encode()
        last = max(k for k, u in enumerate(pages) if (u or "") == (t or ""))
        r = rows[i]
        assert r["response"]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r["metadata"]["payload_bytes"] == len(raw)
        if i == last:
            assert r["response"]["record_type"] == "response" and bytes(r["response"]["payload"]) == raw
        else:
            assert r["response"]["record_type"] == "revisit" and r["response"]["refers_to"] == f"<urn:capture:response:{last}>"
        assert r["request"]["head"].startswith(b"GET /")
    small = {r["page_id"]: r["response"]["record_type"] for r in warc.round_trip(df, min_revisit=50).collect()}
    assert set(small.values()) == {"response"}
    assert warc.round_trip(df.limit(0)).collect() == []


def test_warc_keeps_pages_that_have_no_id_or_repeat_one(spark):
    pages = [(None, "u0", "a"), (None, None, "b"), (5, "u5", "c"), (5, "u5", "d"), (5, "u5", "d"), (3, "u3", "c"), (3, "u3", "d"), (None, "u1", "d"), (9, "u9", "e")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = warc.round_trip(df, with_payload=True).collect()
    assert len({r["response"]["record_id"] for r in rows}) == len(pages)
    digest = {base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(): t for t in "abcde"}
    held = {r["response"]["record_id"]: bytes(r["response"]["payload"]).decode() for r in rows if r["response"]["record_type"] == "response"}
    got = []
    for r in rows:
        text = digest[r["response"]["payload_digest"]]
        assert held[r["response"]["refers_to"] or r["response"]["record_id"]] == text and r["request"] and r["metadata"]
        got.append((r["page_id"], r["target_uri"] or None, text))
    assert sorted(got, key=repr) == sorted(pages, key=repr)
