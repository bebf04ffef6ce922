"""N-gram Jaccard join of whole documents by grouped prefixes.

1. Every document becomes its set of word shingles (128-bit hashes, see ``shingles``).
   Documents with equal sets are one class, known by a digest of the set; a batch of
   texts gives one packed row for each of its classes, so copies meet in few rows, and
   only class members go on.
2. In rarest-first order a prefix of n - ceil(t n) + 1 shingles must hold a common one
   of any linked pair, so a document with that many shingles that no other has links
   with nothing. A fixed part of the shingles tells this of most documents, which end here.
3. All shingles of the documents that are left meet by hash. A batch sends each of its
   distinct shingles once, with the number of its texts that have it, and gets back the
   corpus frequency and an exact number of the shingle in its place; so a shingle that
   every document has is a row a batch, never a row a document. Shingles that one
   document has are dropped, as they can be in no intersection.
4. Documents with the same prefix and size are one group. Groups meet on prefix
   shingles; pairs of groups pass the length and the positional filter, are expanded to
   their members, and every pair of members is verified by the exact intersection.
   Only reachability is asked for, so pairs whose members are already connected are not
   looked at again: first every group meets one pivot group per shingle (its least
   unusual one), then all pairs of groups that are still apart.

Cases: a text of fewer words than a shingle is one shingle of all its words; null texts
and texts without words have an empty set and link with nothing; repeated rows of one
id are one document; ties in the order of shingles go by their numbers, so reruns agree;
any other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from .common import batched, drop_path, keep, lean, lean_group, new_path
from .shingles import WORDS, order_of, shingle_sets

#: Links have at least this many hundredths of their union in common.
PERCENT = 80
#: Texts whose shingles are dealt out together; identical ones among them go once.
BATCH_TEXTS = 3000
#: Documents whose shingles one bucket gets on average.
BUCKET_DOCS = 2000
#: Eighths of the shingles that the first look at a document takes.
SAMPLE_EIGHTHS = 3
#: Bits of the filter of documents that are left after it (4 MB), for up to an eighth as
#: many documents; more of them are joined instead.
FILTER_BITS = 1 << 25
#: In place of a document: several texts of the batch have the shingle.
SEVERAL = 0xFFFF


def needed(n: int, percent: int) -> int:
    """The least intersection of a set of ``n`` with a set that it links with."""
    return -(-percent * n // 100)


def _sets(p: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Both halves of the shingles of all texts, their counts and the digests of the sets."""
    hi, lo, count = [], [], []
    for k in range(0, p.num_rows, 300):
        h, w, n = shingle_sets(p.column(1).slice(k, 300).to_pylist(), words)
        hi.append(h)
        lo.append(w)
        count.append(n)
    hi, lo, count = np.concatenate(hi), np.concatenate(lo), np.concatenate(count)
    ends = np.cumsum(count).tolist()
    cut = lambda x, e, n: x[e - n : e].tobytes()
    return hi, lo, count, [hashlib.blake2b(cut(hi, e, n) + cut(lo, e, n), digest_size=16).digest() for e, n in zip(ends, count.tolist())]


class Chosen:
    """A Bloom filter of ids with a fixed number of bits, so its size never grows. What it
    lets through by mistake is only work."""

    def __init__(self, ids: DataFrame) -> None:
        words = ids.select(F.explode(self.column(F.col("id"))).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, int(bit & 63))").alias("mask"))
        rows = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # FILTER_BITS / 64 rows at most
        bits = np.zeros(FILTER_BITS // 64, np.int64)
        bits[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
        self.shared = ids.sparkSession.sparkContext.broadcast(bits.tobytes())

    def column(self, id_col: F.Column) -> F.Column:
        """The filter's places of an id, for ``has``."""
        return F.array(*[F.pmod(F.xxhash64(id_col, F.lit(k)), F.lit(FILTER_BITS)) for k in range(4)])

    def has(self, places: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.shared.value, np.int64)
        return ((bits[places >> 6] >> (places & 63)) & 1).all(axis=1)


DEALT = "batch long, bucket int, hi binary, lo binary, times binary, docs binary"


def _dealt(plain: DataFrame, words: int, buckets: int, eighths: int, chosen: Chosen | None) -> DataFrame:
    """Batches of texts (``doc_id, text``, and the places in ``chosen``) as their distinct
    shingles by bucket: halves of the hashes, how many texts of the batch have each, and
    which (numbers in the batch). Texts of one batch with equal sets go once, under the
    smallest id. Bucket -1 is the batch's documents: ``hi`` their ids, ``lo`` their digests,
    ``times`` their set sizes, ``docs`` which of them went. With ``eighths`` under 8 only
    that part of the hashes goes, without low halves and with one document a shingle."""
    whole = eighths == 8

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for p in batched(batches, BATCH_TEXTS, column=1):
            if chosen:
                p = p.filter(pa.array(chosen.has(p.column(2).flatten().to_numpy().reshape(-1, 4))))
            if not p.num_rows:
                continue
            hi, lo, count, digest = _sets(p, words)
            ids = p.column(0).to_numpy(zero_copy_only=False)
            first: dict[bytes, int] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                first.setdefault(digest[i], i)
            sent = np.zeros(p.num_rows, bool)
            sent[list(first.values())] = True
            doc = np.repeat(np.arange(p.num_rows), count)
            some = sent[doc] & (hi >> np.uint64(61) < eighths)
            hi, lo, doc = hi[some], lo[some], doc[some]
            order = order_of(hi, lo)
            hi, lo, doc = hi[order], lo[order], doc[order]
            new = np.ones(len(hi), bool)
            new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(hi)))
            bucket = (hi[at] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at, times, bucket = at[order], times[order], bucket[order]
            upto = np.cumsum(times)
            where = np.repeat(at - (upto - times), times) + np.arange(len(doc)) if whole else at
            member = doc[where].astype("<u2")
            if not whole:
                member[times > 1] = SEVERAL
            cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            out = [(number, -1, ids.astype("<i8").tobytes(), b"".join(digest), count.astype("<u4").tobytes(), sent.astype("u1").tobytes())]
            for a, b in zip(cut, [*cut[1:], len(at)]):
                docs = member[(upto[a] - times[a]) : upto[b - 1]] if whole else member[a:b]
                out.append((number, int(bucket[a]), hi[at[a:b]].tobytes(), lo[at[a:b]].tobytes() if whole else b"", times[a:b].astype("<u2").tobytes() if whole else b"", docs.tobytes()))
            number += 1
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], names=[x.split()[0] for x in DEALT.split(", ")])

    return plain.mapInArrow(lean(deal), DEALT)


def class_rows(dealt: DataFrame) -> DataFrame:
    """``digest, n, least, ids``: of every batch the documents of each class. Documents
    without words and rows without an id are classes of their own, without a digest."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            for k in range(p.num_rows):
                ids, raw, count = np.frombuffer(p.column(0)[k].as_py(), "<i8"), p.column(1)[k].as_py(), np.frombuffer(p.column(2)[k].as_py(), "<u4")
                digest = [raw[16 * i : 16 * i + 16] if n else None for i, n in enumerate(count.tolist())]
                held: dict = {}
                for i, d in enumerate(digest):
                    held.setdefault(d or i, []).append(i)
                rows = [(digest[m[0]], int(count[m[0]]), int(ids[m].min()), ids[m]) for m in held.values()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["digest", "n", "least", "ids"])

    return dealt.where("bucket = -1").select("hi", "lo", "times").mapInArrow(unpack, "digest binary, n long, least long, ids array<long>")


def alone_counts(dealt: DataFrame) -> DataFrame:
    """``doc_id, n, alone`` of the documents that went: how many of the sampled shingles no
    other text has. A bucket answers each batch with the numbers of its documents only."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        doc = [np.frombuffer(x, "<u2") for x in pdf["docs"]]
        row = np.repeat(np.arange(len(doc)), [len(x) for x in doc])
        doc, hi = np.concatenate(doc), np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hi"]])
        order = np.argsort(hi, kind="stable")
        run = np.concatenate([[True], hi[order[1:]] != hi[order[:-1]], [True]])
        one = order[run[1:] & run[:-1]]
        one = one[doc[one] != SEVERAL]
        key, times = np.unique(row[one] * (SEVERAL + 1) + doc[one], return_counts=True)
        row, doc = key // (SEVERAL + 1), (key % (SEVERAL + 1)).astype("<u2")
        cut = np.flatnonzero(np.diff(row, prepend=-1)).tolist()
        ends = [*cut[1:], len(row)]
        return pd.DataFrame({"batch": pdf["batch"].to_numpy()[row[cut]], "docs": [doc[a:b].tobytes() for a, b in zip(cut, ends)], "times": [times[a:b].astype("<u4").tobytes() for a, b in zip(cut, ends)]})

    def add(of: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if of.empty:
            return pd.DataFrame({"doc_id": [], "n": [], "alone": []})
        ids, count, sent = (np.frombuffer(of[c].iloc[0], kind) for c, kind in (("hi", "<i8"), ("times", "<u4"), ("docs", "u1")))
        alone = np.zeros(len(ids), np.int64)
        for d, t in zip(answers["docs"], answers["times"]):
            alone[np.frombuffer(d, "<u2")] += np.frombuffer(t, "<u4")
        some = np.flatnonzero((sent > 0) & (count > 0))
        return pd.DataFrame({"doc_id": ids[some], "n": count[some].astype(np.int64), "alone": alone[some]})

    answers = dealt.where("bucket >= 0").select("batch", "bucket", "hi", "docs").groupBy("bucket").applyInPandas(lean_group(meet), "batch long, docs binary, times binary")
    of = dealt.where("bucket = -1").select("batch", "hi", "times", "docs")
    return of.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(add, "doc_id long, n long, alone long")


def repeated_sets(dealt: DataFrame, percent: int) -> DataFrame:
    """``doc_id, n, rare, prefix, tokens`` of the documents that can link: their shingles
    that more than one text has, as exact numbers in ascending order of frequency, and how
    many other shingles they have."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        hi, lo, times = ([np.frombuffer(x, kind) for x in pdf[c]] for c, kind in (("hi", np.uint64), ("lo", np.uint64), ("times", "<u2")))
        ends = np.cumsum([len(x) for x in hi])
        hi, lo, times = np.concatenate(hi), np.concatenate(lo), np.concatenate(times)
        order = order_of(hi, lo)
        new = np.ones(len(hi), bool)
        new[1:] = (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
        df = np.add.reduceat(times[order].astype(np.int64), np.flatnonzero(new))
        which = np.empty(len(hi), np.int64)
        which[order] = np.cumsum(new) - 1
        # a shingle is in one bucket only, so (bucket, rank there) is its number without collisions
        number, df = which + (int(pdf["bucket"].iloc[0]) << 40), df[which]
        split = lambda x, kind: [part.astype(kind).tobytes() for part in np.split(x, ends[:-1])]
        return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "tokens": split(number, "<i8"), "df": split(df, "<u4")})

    def assemble(of: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        told = {b: (t, f) for b, t, f in zip(answers["bucket"], answers["tokens"], answers["df"])}
        doc, token, df, ids, count, sent = [], [], [], None, None, None
        for bucket, hi, times, docs in zip(of["bucket"], of["hi"], of["times"], of["docs"]):
            if bucket < 0:
                ids, count, sent = np.frombuffer(hi, "<i8"), np.frombuffer(times, "<u4").astype(np.int64), np.frombuffer(docs, "u1")
                continue
            times, (t, f) = np.frombuffer(times, "<u2"), told[bucket]
            t, f = np.frombuffer(t, "<i8"), np.frombuffer(f, "<u4")
            often = np.repeat(f > 1, times)
            doc.append(np.frombuffer(docs, "<u2")[often])
            token.append(np.repeat(t, times)[often])
            df.append(np.repeat(f, times)[often])
        out: list = []
        if doc and ids is not None:
            doc, token, df = np.concatenate(doc), np.concatenate(token), np.concatenate(df)
            order = np.lexsort((token, df, doc))
            doc, token = doc[order], token[order]
            edge = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
            for d in np.flatnonzero((sent > 0) & (count > 0)).tolist():
                own, n = token[edge[d] : edge[d + 1]], int(count[d])
                rare, most = n - len(own), n - needed(n, percent) + 1
                if rare < most:
                    out.append((int(ids[d]), n, rare, own[: most - rare], own))
        return pd.DataFrame(out, columns=["doc_id", "n", "rare", "prefix", "tokens"])

    answers = dealt.where("bucket >= 0").select("batch", "bucket", "hi", "lo", "times").groupBy("bucket").applyInPandas(lean_group(meet), "batch long, bucket int, tokens binary, df binary")
    of = dealt.withColumn("hi", F.when(F.col("bucket") < 0, F.col("hi"))).select("batch", "bucket", "hi", "times", "docs")
    return of.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(assemble, "doc_id long, n long, rare long, prefix array<long>, tokens array<long>")


def prefix_length(percent: int) -> F.Column:
    return F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Sets hold repeated shingles only, all that an
    intersection can have. Joins on a document that is in many pairs may be split."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    # row by row inside the JVM: a batch of pairs would hold the sets of long texts many times
    both = F.size(F.array_intersect("ta", "tb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(both * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_links(plain: DataFrame, able: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, component`` of the class representatives that link with another one, among
    the ``able`` ones (doc_id, n)."""
    spark = plain.sparkSession
    total = able.count()
    if total * 8 <= FILTER_BITS:
        chosen = Chosen(able.select(F.col("doc_id").alias("id")))
        some = plain.withColumn("places", chosen.column(F.col("doc_id")))
    else:
        chosen, some = None, plain.join(able.select("doc_id"), "doc_id", "left_semi")
    path = new_path(spark, "ngram-shingles")
    dealt = keep(_dealt(some, words, max(16, total // BUCKET_DOCS), 8, chosen), path=path)
    sets = repeated_sets(dealt, percent)
    # what the filter let through by mistake may be a copy of another document
    sets = keep(sets.join(able.select("doc_id"), "doc_id", "left_semi"), "ngram-sets")
    drop_path(spark, path)
    # groups of equal prefix and size; a group is named by its smallest member
    member = sets.select("doc_id", "n", "rare", F.md5(F.array_join("prefix", ",").cast("binary")).alias("key"))
    named = member.groupBy("key", "n").agg(F.min("doc_id").alias("g"), F.count("*").alias("members"))
    group_of = keep(member.join(named, ["key", "n"]).select("doc_id", "g"), "ngram-groups")
    at = sets.join(group_of.where("doc_id = g").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("g"), "n", "rare", F.posexplode("prefix").alias("i", "token"))
    at = at.select("token", "g", "n", "rare", F.col("i").cast("long").alias("i"))
    # the least unusual group of a shingle is its pivot: the smallest share of unique shingles
    light = F.struct((F.col("rare") / F.col("n")).alias("share"), F.col("g").alias("pg"), F.col("n").alias("pn"), F.col("rare").alias("prare"), F.col("i").alias("pi"))
    # shingles of one group can make no pair
    least = at.groupBy("token").agg(F.min(light).alias("p"), F.count("*").alias("c")).where("c > 1")
    at = keep(at.join(least, "token").select("token", "g", "n", "rare", "i", "p.*"), "ngram-postings")

    def may_link(n1: str, rare1: str, i1: str, n2: str, rare2: str, i2: str) -> F.Column:
        """Length filter, then positional: unique shingles come first in the order and are
        in no intersection, so before this one only repeated ones count."""
        a, b, x, y = F.col(n1), F.col(n2), F.col(i1), F.col(i2)
        need = F.ceil((a + b) * percent / (100 + percent) - 1e-9)
        return (a * 100 >= b * percent) & (b * 100 >= a * percent) & (F.least(x, y) + F.least(a - F.col(rare1) - x, b - F.col(rare2) - y) >= need)

    edges = [_verify(group_of.where("doc_id <> g").select(F.col("g").alias("a"), F.col("doc_id").alias("b")), sets, percent)]
    star = at.where("g <> pg").where(may_link("n", "rare", "i", "pn", "prare", "pi")).select(F.least("g", "pg").alias("a"), F.greatest("g", "pg").alias("b")).distinct()
    edges.append(_verify(star, sets, percent))
    links = keep(edges[0].unionByName(edges[1]), "ngram-links")
    joined = connected_components(links, lambda df: keep(df, "ngram-parts"))
    # every pair of groups that share a prefix shingle and are not wholly connected yet
    part = group_of.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "g", F.coalesce("component", "doc_id").alias("part"))
    part = keep(part, "ngram-part-of")
    spread = part.groupBy("g").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    open_ = at.join(spread, "g").select("token", "g", "n", "rare", "i", "lo", "hi")
    apart = open_.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l < h").select("token")
    prefixes = sets.select(F.col("doc_id").alias("g"), "prefix")
    open_ = keep(open_.join(apart, "token", "left_semi").join(prefixes, "g"), "ngram-open")
    other = open_.select("token", *[F.col(c).alias(f"{c}2") for c in ("g", "n", "rare", "i", "lo", "hi", "prefix")])
    # a pair is made once: at the first shingle that both prefixes have
    at_first = F.get(F.array_intersect("prefix", "prefix2"), 0) == F.col("token")
    groups = open_.join(other, "token").where("g < g2 and (lo <> lo2 or hi <> hi2 or lo <> hi)").where(at_first).where(may_link("n", "rare", "i", "n2", "rare2", "i2")).select("g", "g2").distinct()
    inside = spread.where("lo < hi").select("g", F.col("g").alias("g2"))
    left = part.select("g", F.col("doc_id").alias("a"), F.col("part").alias("pa"))
    right = part.select(F.col("g").alias("g2"), F.col("doc_id").alias("b"), F.col("part").alias("pb"))
    rest = groups.unionByName(inside).join(left, "g").join(right, "g2").where("pa <> pb and (g <> g2 or a < b)").select("a", "b")
    late = keep(_verify(rest.distinct(), sets, percent), "ngram-late")
    if late.isEmpty():
        return joined
    # components of the components: few vertices are left
    of_part = joined.select(F.col("id").alias("u"), F.col("component").alias("v"))
    return connected_components(of_part.unionByName(late), lambda df: keep(df, "ngram-parts"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of every document: the smallest id
    with the same set, and the smallest id that links reach. Rows without an id link with
    nothing and have no class."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = plain.where("doc_id is not null")
    path = new_path(spark, "ngram-sample")
    dealt = keep(_dealt(known, words, max(16, plain.count() // BUCKET_DOCS), SAMPLE_EIGHTHS, None), path=path)
    packed = keep(class_rows(dealt), "ngram-digests")
    # a row for each batch and class: copies of one text are few rows, and the join may be split
    first = packed.where("digest is not null").groupBy("digest").agg(F.min("least").alias("first_id")).withColumnRenamed("digest", "d")
    classes = packed.join(first, F.col("digest") == F.col("d"), "left").select("n", "first_id", F.explode("ids").alias("doc_id"))
    classes = keep(classes.select("doc_id", "n", F.coalesce("first_id", "doc_id").alias("class_id")), "ngram-classes")
    # a part of the shingles tells of most documents that too many of theirs are unique
    reps = classes.where("doc_id = class_id and n > 0").select("doc_id").distinct()
    able = alone_counts(dealt).where(F.col("alone") < prefix_length(percent)).join(reps, "doc_id", "left_semi")
    able = keep(able.groupBy("doc_id").agg(F.min("n").alias("n")), "ngram-able")
    drop_path(spark, path)
    joined = near_links(known, able, words, percent)
    out = classes.join(joined.withColumnRenamed("id", "class_id"), "class_id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return out.unionByName(_without_id(plain, words))


def _without_id(plain: DataFrame, words: int) -> DataFrame:
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batched(batches, BATCH_TEXTS, column=0):
            n = pa.array(shingle_sets(p.column(0).to_pylist(), words)[2], pa.int64())
            nothing = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, n, nothing, nothing], names=["doc_id", "n_shingles", "class_id", "component_id"])

    return plain.where("doc_id is null").select("text").mapInArrow(sizes, "doc_id long, n_shingles long, class_id long, component_id long")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of linked ones stays: that of the smallest id. Documents
    without words or without an id link with nothing and stay."""
    found = components(docs, **options)
    first = found.where("doc_id = component_id or doc_id is null").groupBy("doc_id").agg(F.count("*").alias("times"))
    kept = keep(first, "ngram-kept")
    out = docs.join(kept.where("doc_id is not null").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if not kept.where("times > 1 and doc_id is not null").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id is null"))
