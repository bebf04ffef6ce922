"""Language-model scores of texts by subword lattices.

A word's lattice has an edge for every piece of an existing vocabulary that stands
somewhere in it (and for every byte, so that any word has a way through). The scores of the
vocabulary weigh the edges; the probability of a word is the sum over all its
segmentations, by forward recursion in log space over many words at once. The pieces stay
as they are; their weights, which start at the vocabulary's own scores, are re-estimated by
expected counts over all distinct words of the training documents, each once, as it is new
words that have to be spelled. A training word has one more edge, the word as a whole:

    P(w) = (c(w) - D) / N + D V / N * lattice(w),    D = n1 / (n1 + 2 n2),

with n1, n2 words seen once and twice, so that what the discount takes from words that were
seen goes to the spelling. A text is its words and an end; words carry a mark where they
begin, so no segmentation crosses words and the text's marginal is the product over them.

Words are counted on the executors and stay a table there. The most frequent ones (at most
``HEAD_WORDS`` of at most ``HEAD_BYTES`` bytes, chosen by a count that no more words reach)
go to every task and cover most of a text as it is read; all others are joined by word, so
no word of the join is frequent. Nothing else about words reaches the driver but sums.

Cases: a null or empty text is its end alone; A-Z become lower case, words end at ASCII
white space; rows that repeat or lack an id are scored, and learnt from, as rows of their
own (no id: remainder 0, so a training row); very long words are spelled whole; without
training documents words are spelled by the vocabulary's own scores, and the base gives
every token probability 1; other columns are not read, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, drop_path, keep, new_path

FOLDS, HELD_OUT_FOLD = 5, 1
HEAD_WORDS, HEAD_BYTES = 1 << 17, 256
EM_ROUNDS = 2
#: Pseudo-counts that the vocabulary's own scores are worth, all pieces together.
PRIOR = 1000.0
#: Distinct words that a task counts before it hands them on, and cells of a lattice block.
COUNTED_WORDS, CELLS = 200_000, 400_000
MARK = b" "
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>"


def vocabulary(path: str, ranks: bool = True) -> tuple[list[bytes], np.ndarray]:
    """Pieces, with the mark as a blank, and log probabilities from the scores of a
    SentencePiece file: logarithms as they are, or (``ranks``, as BPE files have them) the
    place k of a piece as a weight of 1 / (1 + k). Every byte is a piece of least weight.
    Pieces with A-Z, or with a mark inside, stand in no word and are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or "▁" in piece[1:] or piece.upper() == piece != piece.lower():
            continue
        if piece.isascii() and piece != piece.lower():
            continue
        weight[piece.replace("▁", " ").encode()] = 1.0 / (1.0 - score) if ranks else float(np.exp(score))
    least = min(weight.values(), default=1.0)
    for b in range(256):
        weight.setdefault(bytes([b]), least)
    pieces = sorted(weight)
    p = np.array([weight[x] for x in pieces])
    return pieces, np.log(p / p.sum())


_tries: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Lattice:
    """All segmentations of words into weighted pieces."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray) -> None:
        self.pieces, self.logp = pieces, logp
        self._next = None

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "logp": self.logp, "_next": None}

    def _build(self) -> None:
        """A trie of the pieces: rows of next nodes by byte; node 0 is none, 1 the root. A
        worker builds it once for all its tasks and rounds, as pieces stay the same."""
        key = hash(tuple(self.pieces))
        if key not in _tries:
            _tries.clear()
            place = {x: i + 2 for i, x in enumerate(sorted({x[:k] for x in self.pieces for k in range(1, len(x) + 1)}))} | {b"": 1}
            follow, piece = np.zeros((len(place) + 1, 256), np.int32), np.full(len(place) + 1, -1, np.int32)
            for x, node in place.items():
                if x:
                    follow[place[x[:-1]], x[-1]] = node
            piece[[place[x] for x in self.pieces]] = np.arange(len(self.pieces))
            _tries[key] = follow, piece
        self._next, self._piece = _tries[key]

    def _blocks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of words of like length, their lengths (falling) and their bytes by position."""
        if self._next is None:
            self._build()
        size = np.array([len(w) + 1 for w in words])
        order = np.argsort(-size, kind="stable")
        at = 0
        while at < len(order):
            n = max(1, CELLS // int(size[order[at]]))
            some = order[at : at + n]
            length = int(size[some[0]])
            raw = b"".join((MARK + words[i]).ljust(length, b"\0") for i in some.tolist())
            yield some, size[some], np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(len(some), length).T)
            at += n

    def _edges(self, size: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``start, end, words, pieces``: by start, pieces that stand in some words there."""
        for start in range(len(text)):
            on = np.arange(np.searchsorted(-size, -start, side="left"))  # words longer than start
            node = self._next[1][text[start, : len(on)]]
            for end in range(start + 1, len(text) + 1):
                live = node > 0
                on, node = on[live], node[live]
                if not len(on):
                    break
                piece = self._piece[node]
                has = piece >= 0
                if has.any():
                    yield start, end, on[has], piece[has]
                if end == len(text):
                    break
                inside = size[on] > end
                on = on[inside]
                node = self._next[node[inside], text[end, on]]

    def _forward(self, size: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list]:
        alpha = np.full((len(text) + 1, len(size)), -np.inf)
        alpha[0] = 0.0
        edges = []
        for start, end, on, piece in self._edges(size, text):
            alpha[end, on] = np.logaddexp(alpha[end, on], alpha[start, on] + self.logp[piece])
            edges.append((start, end, on, piece))
        return alpha, edges

    def log_likelihood(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of the sum over all segmentations, for every word."""
        out = np.zeros(len(words))
        for some, size, text in self._blocks(words):
            alpha, _ = self._forward(size, text)
            out[some] = alpha[size, np.arange(len(size))]
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """How often each piece is expected over all segmentations of all words."""
        out = np.zeros(len(self.pieces))
        for _, size, text in self._blocks(words):
            alpha, edges = self._forward(size, text)
            beta = np.full_like(alpha, -np.inf)
            each = np.arange(len(size))
            beta[size, each] = 0.0
            total = alpha[size, each]
            for start, end, on, piece in reversed(edges):
                way = self.logp[piece] + beta[end, on]
                beta[start, on] = np.logaddexp(beta[start, on], way)
                out += np.bincount(piece, np.exp(alpha[start, on] + way - total[on]), len(out))
        return out


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case: bytes know ASCII letters and blanks only."""
    return text.lower().split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT_FOLD


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c, total``: occurrences in training rows and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(seen[0] | seen[1])
            train = [seen[0][w] for w in words]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(train, pa.int64()), pa.array([t + seen[1][w] for w, t in zip(words, train)], pa.int64())], names=["word", "c", "total"])
            for s in seen:
                s.clear()
            return out

        for b in batched(batches, 4096, column=1):
            for out, text in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
                seen[out].update(words_of(text))
            if len(seen[0]) + len(seen[1]) > COUNTED_WORDS:
                yield flush()
        if seen[0] or seen[1]:
            yield flush()

    counted = docs.select("doc_id", F.col("text").cast("binary"), "held_out").mapInArrow(count, "word binary, c long, total long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def estimate(words: DataFrame, start: Lattice, rounds: int) -> Lattice:
    """Weights of the pieces from their expected counts in all training words, each once."""
    known = words.where("c > 0").select("word")
    now = start
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], now: Lattice = now) -> Iterator[pa.RecordBatch]:
            total = sum((now.expected(b.column(0).to_pylist()) for b in batches), np.zeros(len(now.pieces)))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "n"])

        # one row for each piece of the vocabulary at most
        rows = known.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        count = PRIOR * np.exp(start.logp)
        for r in rows:
            count[r["piece"]] += r["n"]
        now = Lattice(start.pieces, np.log(count / count.sum()))
    return now


def head_least(words: DataFrame, most: int) -> int:
    """The least count that no more than ``most`` words reach, from numbers of words by the
    size of their counts in eighths of a doubling."""
    by = words.groupBy(F.floor(F.log2("total") * 8).cast("int").alias("size")).agg(F.count("*").alias("n"), F.min("total").alias("least")).collect()
    held, least = 0, 1 << 62
    for r in sorted(by, key=lambda r: -r["size"]):
        held += r["n"]
        if held > most:
            break
        least = r["least"]
    return least


def score_texts(docs: DataFrame, vocabulary_path: str, ranks: bool = True, rounds: int = EM_ROUNDS, head_words: int = HEAD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10)."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    counted = new_path(spark, "lattice-words")
    words = keep(count_words(plain), path=counted)
    start = Lattice(*vocabulary(vocabulary_path, ranks))
    lattice = estimate(words, start, rounds)

    sums = words.where("c > 0").agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    n_words, v_words, once, twice = (int(x or 0) for x in sums)
    ends = plain.where("not held_out").count()
    n, v = n_words + ends, v_words + (ends > 0)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    p_end = (ends + 0.5) / (n + 1.0)
    base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    def model_of(c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 of the probability of words as the next token."""
        escape = np.log(discount * v_words / n_words) if n_words else 0.0
        with np.errstate(divide="ignore"):
            seen = np.log(np.maximum(c - discount, 0.0) / max(n_words, 1))
        return (np.logaddexp(seen, escape + spelled) + np.log1p(-p_end)) / np.log(10)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array((c > 0).astype(np.int64)), pa.array(base_of(c)), pa.array(model_of(c, lattice.log_likelihood(b.column(0).to_pylist())))], names=["word", "total", "known", "base", "score"])

    scored_words = new_path(spark, "lattice-scores")
    judged = keep(words.mapInArrow(judge, "word binary, total long, known long, base double, score double"), path=scored_words)
    drop_path(spark, counted)
    frequent = (F.col("total") >= head_least(judged, head_words)) & (F.octet_length("word") <= HEAD_BYTES)
    head = judged.where(frequent).collect()  # head_words rows of HEAD_BYTES at most
    place = {bytes(r["word"]): i for i, r in enumerate(head)}
    value = np.array([(r["known"], r["base"], r["score"]) for r in head]).reshape(-1, 3)
    # the end of a text, and words that are not in the head
    end, rare = len(head), len(head) + 1
    value = np.vstack([value, [float(ends > 0), base_of(ends), np.log10(p_end)], [0.0, 0.0, 0.0]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches, 512, column=1):
            words_, counts, rares = [], [], []
            for t in b.column(1).to_pylist():
                w = words_of(t)
                words_ += w
                words_.append(b"")
                counts.append(len(w) + 1)
            counts = np.array(counts)
            last = np.cumsum(counts)
            at = np.fromiter(map(place.get, words_, repeat(rare)), np.int64, len(words_))
            at[last - 1] = end
            sums = np.add.reduceat(value[at], last - counts, axis=0)
            far = np.flatnonzero(at == rare)
            rares = pa.array([words_[i] for i in far.tolist()], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(far, np.append(0, last)).astype(np.int32)), rares)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1]), pa.array(sums[:, 2]), lists], names=[x.split()[0] for x in SCORED.split(", ")])

    texts = plain.select("doc_id", F.col("text").cast("binary"), "held_out").mapInArrow(read, SCORED)
    # rows are numbered once and kept, as ids may repeat
    rows = keep(texts.withColumn("row", F.monotonically_increasing_id()), "lattice-texts")
    tail = rows.select("row", F.explode("rare").alias("word")).join(judged.where(~frequent).hint("merge"), "word")
    more = tail.groupBy("row").agg(*[F.sum(c).alias(f"more_{c}") for c in ("known", "base", "score")])
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return rows.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"),
    )
