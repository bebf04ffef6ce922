"""Removal of long repeated substrings by prefix-free parsing.

Texts are byte strings. Every window of ``window`` bytes has one trigger, the substring
of it with the smallest rolling hash; consecutive windows with the same trigger form a
phrase, and neighbouring phrases overlap by a window less one byte. The parse of a text
is its sequence of phrases; the dictionary holds the distinct phrases. Equal windows have
equal triggers at the same place, so both orders are dealt out by trigger:

* suffixes of the parse are ordered by trigger and first phrase, all of it that a string
  of ``window`` bytes can reach. Phrases that stand there twice are repeated as a whole;
  a phrase whose trigger no other phrase has is unique in all its windows;
* of the others, the suffixes of dictionary phrases are ordered by their first ``window``
  bytes (a suffix array by doubling, on the bytes themselves), each phrase once. Suffixes
  that tie are repeated windows.

Ties of both orders together are all places of the corpus whose next ``window`` bytes
stand elsewhere; what follows beyond them cannot matter, so neither order goes deeper.
A trigger class of more than ``HOT_CLASS`` distinct phrases is split: windows that hold
the trigger at about the same place share a core of bytes around it, and those that share
trigger, place and core are ordered together. Texts of one batch that are equal there, or
have equal phrases, send them once, so copies do not pile up.

Phrases are named by 128-bit BLAKE2b of their bytes (10^13 distinct ones: two share a
name with a chance of 10^-13); windows are compared byte by byte.

Cases: a null text is empty; texts shorter than the window lose nothing; repeated rows
repeat each other's bytes and are rows of their own (a number made at the start names
them), so ids may be null or repeated; every copy of a tie goes, none is preferred; long
texts are parsed in overlapping pieces; other columns are carried whatever their names;
an empty table gives no rows.
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

from .common import batched, keep, lean, lean_group
from .parsing import TRIGGER, parse, suffix_ranks

WINDOW = 200
BATCH_TEXTS = 2000
#: Bytes of text for each bucket of triggers, on average.
BUCKET_BYTES = 6_000_000
#: Bytes of phrases that are ordered together in one bucket; classes are never parted.
SORT_BYTES = 1_000_000
#: Distinct phrases of a trigger beyond which its windows are dealt out by their cores.
HOT_CLASS = 2000
#: Parts by the trigger's place in a window that a hot class is split into first.
HOT_PARTS = 8


def _numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """``key, row, size, z``: a number for each row, its columns, and its text compressed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    plain = docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.drop(text_col).columns).alias("row") if len(docs.columns) > 1 else F.struct(F.lit(0)).alias("row"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for p in batches:
            for k in range(0, p.num_rows, 1000):
                q = p.slice(k, 1000)
                texts = q.column(2)
                sizes = pa.compute.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([q.column(0), q.column(1), sizes, pa.array([squeeze(t.as_py()) for t in texts], pa.binary())], names=["key", "row", "size", "z"])

    return plain.mapInArrow(lean(run), f"key long, row {dict(plain.dtypes)['row']}, size long, z binary")


def _rows(cols: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of every run of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist() if len(x) else []
    return list(zip(cut, [*cut[1:], len(x)]))


PARTS = "bucket long, keys binary, local binary, begins binary, starts binary, offsets binary, triggers binary, names binary, many binary"


def dictionary_parts(texts: DataFrame, window: int, trigger_bytes: int, buckets: int) -> DataFrame:
    """Distinct phrases of every batch, dealt out by trigger. What a batch has more than
    once is repeated already: such windows go along without a trigger."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loosen = zstandard.ZstdDecompressor().decompress
        number = TaskContext.get().partitionId()
        for p in batched(batches, BATCH_TEXTS, column=1, most_bytes=1 << 22):
            keys = p.column(0).to_numpy()
            x = parse([loosen(z.as_py()) for z in p.column(1)], window, trigger_bytes)
            order = np.lexsort((x.name[:, 1], x.name[:, 0], x.trigger))
            doc, begin, starts, offset, trigger, name = (c[order] for c in x)
            new = np.ones(len(order), bool)
            new[1:] = (trigger[1:] != trigger[:-1]) | (name[1:] != name[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            out = []
            twice = np.flatnonzero(np.repeat(times > 1, times))
            if len(twice):
                twice = twice[np.lexsort((begin[twice], doc[twice]))]
                d, b, n = doc[twice], begin[twice], starts[twice]
                fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (b[1:] != b[:-1] + n[:-1])])
                n = np.add.reduceat(n, np.flatnonzero(fresh))
                used, local = np.unique(d[fresh], return_inverse=True)
                out.append((number % buckets, keys[used].astype("<i8").tobytes(), local.astype("<u2").tobytes(), b[fresh].astype("<u4").tobytes(), n.astype("<u4").tobytes(), b"", b"", b"", b""))
            bucket = (trigger[first] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first, times, bucket = first[order], times[order], bucket[order]
            for a, b in _runs(bucket):
                f, t = first[a:b], times[a:b]
                used, local = np.unique(doc[f], return_inverse=True)
                out.append((int(bucket[a]), keys[used].astype("<i8").tobytes(), local.astype("<u2").tobytes(), begin[f].astype("<u4").tobytes(), starts[f].astype("<u4").tobytes(), offset[f].astype("<u2").tobytes(), trigger[f].tobytes(), name[f].tobytes(), (t > 1).astype("u1").tobytes()))
            if out:
                yield _rows(list(zip(*out)), [pa.int64()] + [pa.binary()] * 8, [c.split()[0] for c in PARTS.split(", ")])

    return texts.mapInArrow(lean(deal), PARTS)


JUDGED = "key long, begin long, starts long, offset int, kind int, trigger long, hot boolean"


def judge_phrases(pdf: pd.DataFrame, hot_class: int = HOT_CLASS) -> pd.DataFrame:
    """Of one bucket of the parse: windows repeated as a whole (``kind`` 2), and of every
    trigger with several phrases one place of each (1: alone, 0: repeated)."""
    of = lambda part, col, kind: np.concatenate([np.frombuffer(x, kind) for x in part[col]] or [np.zeros(0, kind)])
    place = lambda part: np.concatenate([np.frombuffer(k, "<i8")[np.frombuffer(i, "<u2")] for k, i in zip(part["keys"], part["local"])] or [np.zeros(0, np.int64)])
    known = pdf["triggers"].str.len() == 0
    done, pdf = pdf[known], pdf[~known]
    out = [pd.DataFrame({"key": place(done), "begin": of(done, "begins", "<u4").astype(np.int64), "starts": of(done, "starts", "<u4").astype(np.int64), "offset": 0, "kind": 2, "trigger": 0, "hot": False})]
    key, name = place(pdf), of(pdf, "names", "<u8").reshape(-1, 2)
    begin, starts, offset, trigger, many = (of(pdf, c, k) for c, k in (("begins", "<u4"), ("starts", "<u4"), ("offsets", "<u2"), ("triggers", np.uint64), ("many", "u1")))
    order = np.lexsort((name[:, 1], name[:, 0], trigger))
    key, begin, starts, offset, trigger, many, name = (c[order] for c in (key, begin, starts, offset, trigger, many, name))
    n = len(order)
    new_class = np.ones(n, bool)
    new_class[1:] = trigger[1:] != trigger[:-1]
    new_phrase = new_class.copy()
    new_phrase[1:] |= (name[1:] != name[:-1]).any(axis=1)
    class_of, phrase_of = np.cumsum(new_class) - 1, np.cumsum(new_phrase) - 1
    times = np.bincount(phrase_of, weights=1 + many)[phrase_of]
    distinct = np.bincount(class_of, weights=new_phrase).astype(np.int64)[class_of]
    whole = np.flatnonzero((times > 1) & (many == 0))
    mixed = np.flatnonzero(new_phrase & (distinct > 1))
    at = np.concatenate([whole, mixed])
    kind = np.concatenate([np.full(len(whole), 2), (times[mixed] < 2).astype(np.int64)]).astype(np.int32)
    out.append(pd.DataFrame({"key": key[at], "begin": begin[at].astype(np.int64), "starts": starts[at].astype(np.int64), "offset": offset[at].astype(np.int32), "kind": kind, "trigger": trigger[at].view(np.int64), "hot": distinct[at] > hot_class}))
    return pd.concat(out)


def hot_parts(text: bytes, begin: int, starts: int, offset: int, window: int, trigger_bytes: int) -> list[tuple[int, int, int, bytes]]:
    """A hot phrase's windows by where they hold the trigger: (part, first start, number
    of starts, the core that all windows of this part around this trigger hold)."""
    places = window - trigger_bytes + 1
    wide = -(-places // HOT_PARTS)
    at, out = begin + offset, []
    for part in range(-(-places // wide)):
        low, high = at - (part + 1) * wide + 1, at - part * wide
        a, b = max(low, begin), min(high, begin + starts - 1)
        if a <= b:
            out.append((part, a, b - a + 1, text[max(high, 0) : low + window]))
    return out


def _class_key(*parts: bytes | int) -> int:
    h = hashlib.blake2b(digest_size=8)
    for x in parts:
        h.update(x if isinstance(x, bytes) else x.to_bytes(8, "little", signed=True))
    return int.from_bytes(h.digest(), "little") >> 1


def repeated_windows(packed: DataFrame, mixed: DataFrame, window: int, trigger_bytes: int, buckets: int) -> DataFrame:
    """``key, spans`` of the windows that phrases of one trigger share. A phrase goes as
    bytes to its trigger's bucket, those of a hot class to the buckets of their cores."""
    asked = mixed.groupBy("key").agg(F.collect_list(F.struct("begin", "starts", "offset", "kind", "trigger", "hot")).alias("asked"))
    both = packed.select("key", "z").join(asked, "key")
    names, types = ["bucket", "class", "key", "begin", "starts", "need", "part"], [pa.int64()] * 5 + [pa.bool_(), pa.binary()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loosen = zstandard.ZstdDecompressor().decompress
        for p in batches:
            out: list = []
            size, alike = 0, {}
            for key, z, asked_ in zip(p.column(0).to_pylist(), p.column(1), p.column(2).to_pylist()):
                text = loosen(z.as_py())
                for a in asked_:
                    begin, starts, need = a["begin"], a["starts"], a["kind"] == 1
                    if not a["hot"]:
                        own = _class_key(a["trigger"])
                        out.append((own % buckets, own, key, begin, starts, need, text[begin : begin + starts + window - 1]))
                        size += starts + window
                        continue
                    for part, b, n, core in hot_parts(text, begin, starts, a["offset"], window, trigger_bytes):
                        own, raw = _class_key(a["trigger"], part, core), text[b : b + n + window - 1]
                        size += len(raw)
                        alike.setdefault((own, raw), []).append((key, b, n, need))
                if size > 1 << 23:
                    yield from flush(out, alike)
                    out, size, alike = [], 0, {}
            yield from flush(out, alike)

    def flush(out: list, alike: dict) -> Iterator[pa.RecordBatch]:
        # strings that a batch has twice are repeated; one of them goes on as a witness
        for (own, raw), places in alike.items():
            key, b, n, need = places[0]
            out.append((own % buckets, own, key, b, n, need and len(places) == 1, raw))
            if len(places) > 1:
                out += [(own % buckets, own, key, b, n, True, None) for key, b, n, need in places if need]
        if out:
            yield _rows(list(zip(*out)), types, names)

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        told = pdf["part"].isna()
        out = [pdf.loc[told, ["key", "begin", "starts"]]]
        pdf = pdf[~told]
        pdf = pdf.iloc[np.argsort(pdf["class"].to_numpy(), kind="stable")]
        sizes = pdf["part"].str.len().to_numpy(np.int64)
        group, at = pdf["class"].to_numpy(), 0
        total = np.cumsum(sizes)
        for a, b in _runs(group):
            if b < len(group) and total[b - 1] - (total[at - 1] if at else 0) < SORT_BYTES:
                continue
            some = pdf.iloc[at:b]
            _, shared = suffix_ranks(some["part"].tolist(), window)
            found = np.flatnonzero(shared & np.repeat(some["need"].to_numpy(bool), sizes[at:b]))
            ends = total[at:b] - (total[at - 1] if at else 0)
            r = np.searchsorted(ends, found, side="right")
            w = found - (ends - sizes[at:b])[r]
            # consecutive windows of a phrase go as one span
            cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)])) if len(found) else np.zeros(0, np.int64)
            out.append(pd.DataFrame({"key": some["key"].to_numpy()[r[cut]], "begin": some["begin"].to_numpy()[r[cut]] + w[cut], "starts": np.diff(np.append(cut, len(found)))}))
            at = b
        return pd.concat(out)

    dealt = both.mapInArrow(lean(deal), "bucket long, class long, key long, begin long, starts long, need boolean, part binary")
    return dealt.groupBy("bucket").applyInPandas(lean_group(rank), "key long, begin long, starts long")


def removed_runs(begin: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal runs (begin, end) of bytes that repeated windows cover."""
    order = np.argsort(begin, kind="stable")
    begin = begin[order]
    end = np.maximum.accumulate(begin + starts[order] + window - 1)
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return np.stack([begin[first], end[np.append(first[1:], len(begin)) - 1]], axis=1)


def _cut_texts(docs: DataFrame, text_col: str, window: int, trigger: int, with_text: bool, hot_class: int) -> DataFrame:
    """``row`` (a row's other columns), the four figures and, ``with_text``, ``kept``."""
    packed = keep(_numbered(docs, text_col), "parse-texts")
    buckets = max(16, (packed.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES)
    judged = keep(dictionary_parts(packed.select("key", "z"), window, trigger, buckets).groupBy("bucket").applyInPandas(lean_group(lambda pdf: judge_phrases(pdf, hot_class)), JUDGED), "parse-judged")
    found = judged.where("kind = 2").select("key", "begin", "starts").unionByName(repeated_windows(packed, judged.where("kind < 2"), window, trigger, buckets))
    # a text has no more spans than bytes, so what one row collects is bounded by its text
    spans = found.groupBy("key").agg(F.collect_list("begin").alias("begins"), F.collect_list("starts").alias("starts"))
    shape = f"row {dict(packed.dtypes)['row']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loosen = zstandard.ZstdDecompressor().decompress
        for p in batches:
            for k in range(0, p.num_rows, 500):
                q, out = p.slice(k, 500), []
                for z, b, n in zip(q.column(1), q.column(2), q.column(3)):
                    text = loosen(z.as_py())
                    runs = removed_runs(b.values.to_numpy(), n.values.to_numpy(), window) if b.is_valid and len(b) else np.zeros((0, 2), np.int64)
                    at, kept = 0, []
                    for a, e in runs.tolist():
                        kept.append(text[at:a])
                        at = e
                    kept = b"".join([*kept, text[at:]])
                    out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
                cols = list(zip(*out))[: 4 + with_text]
                arrays = [q.column(0)] + [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2)]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return packed.join(spans, "key", "left").select("row", "z", "begins", "starts").mapInArrow(lean(cut), shape)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, trigger: int = TRIGGER, with_text: bool = False, hot_class: int = HOT_CLASS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; ``with_text``
    adds ``kept``, the remaining text without letters that were cut through."""
    done = _cut_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", window, trigger, with_text, hot_class)
    return done.select(F.col("row.doc_id").alias("doc_id"), *done.columns[1:])


def without_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, trigger: int = TRIGGER, hot_class: int = HOT_CLASS) -> DataFrame:
    """The documents with the remaining texts, in the columns of ``docs``. A text of which
    nothing remains goes; one that was empty before stays, a null text as an empty one."""
    done = _cut_texts(docs, text_col, window, trigger, True, hot_class).where("n_removed = 0 or n_removed < n_bytes and kept <> ''")
    shorter = F.when(F.col("n_removed") > 0, F.length("kept"))
    new = {c: F.col("row")[c] for c in docs.columns if c != text_col} | {text_col: F.col("kept")}
    if "n_chars" in new:
        new["n_chars"] = F.coalesce(shorter.cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return done.select(*[new[c].alias(c) for c in docs.columns])
