"""Quality classifier by co-training.

One view is the text's content (how classes of characters follow each other, shares of
hashed words), the other the page's metadata: what is known of a page without its words
(language, source, stated length, number and lengths of its lines and words, and how many
of them repeat). No feature is in both. Each view has a classifier of its own. In every round
each classifier labels the pool documents that it is surest of and hands them, as
pseudo-labels, to the other one, which is fitted anew. A view teaches only while its sure
answers are right on labelled rows set apart, and keeps its best model by those rows. At the end each view is calibrated
on labelled rows that neither was fitted on, and the calibrated views are combined by
weights fitted on the same rows; then every document is scored.

Fitted on bounded samples (``LABELLED_ROWS`` rows with labels among the documents that
are there, ``POOL_ROWS`` without, those with the smallest hashes of their ids);
everything else covers all documents. Rounds matter where labels are few; with many the
pool says little that they do not (README has figures).

Cases: a null or empty text and null metadata have feature values of their own; labels
that are null or that name no document are not used; several labels of a document: the
smallest counts; of several rows with a labelled id the smallest text counts; documents
that a view is equally sure of go by the order of their ids' hashes, so reruns agree;
without any usable labels every document gets score 1, as nothing speaks against it;
repeated rows get equal scores; long texts are read whole, block by block; other columns
are carried whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, lean
from .linear import Logistic, logit, sigmoid
from .shingles import word_hashes

LABELLED_ROWS = 10_000
POOL_ROWS = 10_000
ROUNDS = 4
#: A pseudo-label counts only where its classifier is at least this sure.
SURE = 0.95
#: Share of sure answers that must be right on labelled rows set apart.
RIGHT = 0.9
#: Pseudo-labels that a view hands over in a round, as a share of the pool.
HAND_OVER = 0.05


def _classes() -> np.ndarray:
    """Class of every byte: what kind of character it is part of."""
    kind = np.full(256, 10, np.uint8)
    kind[128:] = 9
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"%$&#*@^~+_", b"|/\\<>=()[]{}\"'`-")):
        kind[list(chars)] = k
    return kind


KINDS = 11
#: Bytes whose character pairs are counted at once.
BLOCK = 1 << 19
CLASS_OF = _classes()
#: Slots of hashed words.
WORD_SLOTS = 128
CONTENT_WIDTH = KINDS * KINDS + WORD_SLOTS + 1
SOURCE_SLOTS, LANG_SLOTS = 64, 16
LAYOUT = 9
META_WIDTH = SOURCE_SLOTS + LANG_SLOTS + LAYOUT


def view_features(texts: pa.Array, langs: list, sources: list, lengths: list) -> tuple[np.ndarray, np.ndarray]:
    """A row per text for each view."""
    strings = texts.to_pylist()
    words, counts = word_hashes(strings)
    return content_features(strings, words, counts), metadata_features(strings, words, counts, langs, sources, lengths)


def content_features(strings: list[str | None], words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of character-class pairs and of hashed words."""
    raw = [(s or "").encode("utf-8", "replace") for s in strings]
    sizes = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((len(raw), CONTENT_WIDTH), np.float32)
    codes = CLASS_OF[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    seen = np.zeros(len(raw) * KINDS * KINDS, np.int64)
    for k in range(0, len(codes) - 1, BLOCK):  # long texts block by block, so memory stays bounded
        now, then = slice(k, min(k + BLOCK, len(codes) - 1)), slice(k + 1, min(k + BLOCK, len(codes) - 1) + 1)
        pair = (doc[now] * (KINDS * KINDS) + codes[now] * KINDS + codes[then])[doc[now] == doc[then]]
        seen += np.bincount(pair, minlength=len(seen))
    out[:, : KINDS * KINDS] = np.sqrt(seen.reshape(len(raw), -1) / np.maximum(sizes[:, None] - 1, 1))
    slot = np.repeat(np.arange(len(raw)) * WORD_SLOTS, counts) + (words[:, 0] % np.uint64(WORD_SLOTS)).astype(np.int64)
    shares = np.bincount(slot, minlength=len(raw) * WORD_SLOTS).reshape(len(raw), -1) / np.maximum(counts[:, None], 1)
    out[:, KINDS * KINDS : -1] = np.sqrt(shares)
    out[:, -1] = sizes == 0
    return out


def metadata_features(strings: list[str | None], words: np.ndarray, counts: np.ndarray, langs: list, sources: list, lengths: list) -> np.ndarray:
    """Language, source, stated length and layout."""
    slot = lambda x, slots: zlib.crc32(b"" if x is None else b"=" + str(x).encode("utf-8", "replace")) % slots
    out = np.zeros((len(strings), META_WIDTH), np.float32)
    ends = np.cumsum(counts)
    for i, (text, lang, source, n) in enumerate(zip(strings, langs, sources, lengths)):
        out[i, slot(source, SOURCE_SLOTS)] = 1
        out[i, SOURCE_SLOTS + slot(lang, LANG_SLOTS)] = 1
        lines = [x for x in (text or "").split("\n") if x]
        size, own = [len(x) for x in lines] or [0], words[ends[i] - counts[i] : ends[i], 0]
        letters = sum(size)
        repeats = 1 - len(set(lines)) / len(lines) if lines else 0
        again = 1 - len(np.unique(own)) / len(own) if len(own) else 0
        out[i, -LAYOUT:] = (
            0 if n is None else np.log1p(max(int(n), 0)), n is None, np.log1p(len(lines)), np.log1p(letters / len(size)), np.log1p(max(size)),
            repeats, again, letters / max(1, len(own)) / 10, np.log1p(len(own)),
        )
    return out


class CoTrained:
    """Both views' classifiers, their calibration and how they are combined."""

    def fit(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pools: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> CoTrained:
        self.constant = len(y) == 0
        if self.constant:
            return self
        held = np.arange(len(y)) % 5 == 4  # rows come in the order of a hash
        known, own_y = [v[~held] for v in views], y[~held]
        given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        taken = [np.zeros(len(pools[0]), bool), np.zeros(len(pools[0]), bool)]
        share = float(own_y.mean()) if len(own_y) else 0.5
        kept: list[tuple[float, Logistic]] = [(np.inf, Logistic()), (np.inf, Logistic())]
        for r in range(rounds + 1):
            self.models = []
            for v in (0, 1):
                x = np.vstack([known[v], *[pools[v][i] for i, _ in given[v]]])
                z = np.concatenate([own_y, *[t for _, t in given[v]]])
                # pseudo-labels count half
                w = np.concatenate([np.ones(len(own_y)), np.full(len(z) - len(own_y), 0.5)])
                self.models.append(Logistic(penalty=3.0).fit(x, z, w))
                # of all rounds each view keeps the model that is best on rows set apart
                p = np.clip(self.models[v].predict(views[v][held]), 1e-9, 1 - 1e-9)
                loss = -float((y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).sum())
                if loss < kept[v][0]:
                    kept[v] = (loss, self.models[v])
            if r == rounds or not len(pools[0]):
                break
            for v in (0, 1):  # v teaches the other view
                if not self._trusted(self.models[v].predict(views[v][held]), y[held]):
                    continue
                p = self.models[v].predict(pools[v])
                n = max(1, int(HAND_OVER * len(p)))
                free = ~taken[v]
                best = lambda score, k: np.argsort(-np.where(free, score, -1.0), kind="stable")[:k]  # noqa: B023, E731
                good, bad = best(p, max(1, round(n * share))), best(1 - p, max(1, round(n * (1 - share))))
                good, bad = good[free[good] & (p[good] >= SURE)], bad[free[bad] & (p[bad] <= 1 - SURE)]
                chosen = np.concatenate([good, bad])
                taken[v][chosen] = True
                if len(chosen):
                    given[1 - v].append((chosen, np.concatenate([np.ones(len(good)), np.zeros(len(bad))])))
        self.models = [m for _, m in kept]
        test_y = y[held] if held.any() and y[held].min() != y[held].max() else y
        rows = held if test_y is not y else np.ones(len(y), bool)
        self.calibrated = [Logistic(penalty=0.1).fit(m.decision(v[rows])[:, None], test_y) for m, v in zip(self.models, views)]
        self.combined = Logistic(penalty=0.1).fit(self._logits([v[rows] for v in views]), test_y)
        return self

    @staticmethod
    def _trusted(p: np.ndarray, y: np.ndarray) -> bool:
        """Whether both kinds of sure answers are right often enough on rows set apart."""
        good, bad = y[p >= SURE], y[p <= 1 - SURE]
        return all(len(kind) and (kind == k).mean() >= RIGHT for kind, k in ((good, 1), (bad, 0)))

    def _logits(self, views: list[np.ndarray]) -> np.ndarray:
        return np.stack([logit(c.predict(m.decision(v)[:, None])) for m, c, v in zip(self.models, self.calibrated, views)], axis=1)

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant:
            return (np.ones(len(content)),) * 3
        z = self._logits([content, metadata])
        return sigmoid(z[:, 0]), sigmoid(z[:, 1]), self.combined.predict(z)


def _columns(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, length_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.col(length_col).cast("long").alias("n_chars"),
    )


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS) -> CoTrained:
    """Fits on a labelled sample and an unlabelled pool of at most the stated sizes."""
    spark = docs.sparkSession
    one = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y"))
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    there = one.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(*by_hash).limit(labelled_rows).toPandas()  # at most labelled_rows rows of two numbers
    pool = docs.select("doc_id").where("doc_id is not null").orderBy(*[F.xxhash64("doc_id", F.lit(1)), "doc_id"]).limit(pool_rows).toPandas()
    ids = {int(i): int(y) for i, y in zip(chosen["doc_id"], chosen["y"])}
    wanted = [(i, y) for i, y in ids.items()] + [(int(i), None) for i in set(pool["doc_id"]) if int(i) not in ids]
    if not ids or not wanted:
        return CoTrained().fit((np.zeros((0, CONTENT_WIDTH)), np.zeros((0, META_WIDTH))), np.zeros(0), (np.zeros((0, CONTENT_WIDTH)), np.zeros((0, META_WIDTH))))
    sample = F.broadcast(spark.createDataFrame(wanted, "doc_id long, y int"))  # labelled_rows + pool_rows rows at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batched(batches, 500, column=1):
            content, meta = view_features(p.column("text"), *[p.column(c).to_pylist() for c in ("lang", "source", "n_chars")])
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("y"), pa.array(content.tobytes()[i * CONTENT_WIDTH * 4 : (i + 1) * CONTENT_WIDTH * 4] for i in range(len(content))), pa.array(meta.tobytes()[i * META_WIDTH * 4 : (i + 1) * META_WIDTH * 4] for i in range(len(meta)))], names=["doc_id", "y", "content", "meta"])

    rows = docs.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
    got = rows.select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars", "y").mapInArrow(lean(features), "doc_id long, y int, content binary, meta binary").toPandas()
    got["order"] = [zlib.crc32(str(i).encode()) for i in got["doc_id"]]
    got = got.sort_values(["order", "doc_id"])
    matrix = lambda col, width: np.frombuffer(b"".join(col), np.float32).reshape(-1, width)
    known, rest = got[got["y"].notna()], got[got["y"].isna()]
    return CoTrained().fit(
        (matrix(known["content"], CONTENT_WIDTH), matrix(known["meta"], META_WIDTH)), (known["y"].to_numpy(np.float64) > 0).astype(np.float64),
        (matrix(rest["content"], CONTENT_WIDTH), matrix(rest["meta"], META_WIDTH)), rounds,
    )


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", length_col: str = "n_chars", **options) -> DataFrame:
    """``doc_id, content_score, metadata_score, score, predicted`` for every document."""
    plain = _columns(docs, id_col, text_col, lang_col, source_col, length_col)
    model = train(plain, labels, label_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batched(batches, 500, column=1):
            a, m, s = model.score(*view_features(p.column("text"), *[p.column(c).to_pylist() for c in ("lang", "source", "n_chars")]))
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(a), pa.array(m), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "content_score", "metadata_score", "score", "predicted"])

    return plain.mapInArrow(lean(run), "doc_id long, content_score double, metadata_score double, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents whose score is at least ``threshold``, with their columns. Rows are
    judged where they stand, so nothing is joined and ids need not be unique."""
    model = train(_columns(docs, "doc_id", "text", "lang", "source", "n_chars"), labels, **options)

    text, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batched(batches, 500, column=text):
            s = model.score(*view_features(p.column(text), *[p.column(names.index(c)).to_pylist() for c in ("lang", "source", "n_chars")]))[2]
            yield p.filter(pa.array(s >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
