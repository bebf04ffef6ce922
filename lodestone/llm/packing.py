"""Harmonic packing of tokenised documents into training sequences.

With capacity C a length in (C / (k + 1), C / k] is of class k, and a bin of class k
holds exactly k pieces. Documents may be cut, so a document gives full bins, then
pieces of exactly C / 2, C / 4, ... down to ``MIN_PIECE`` tokens, which fill their bins
without a gap, and one tail of fewer tokens, whose bins lose less than C / (k + 1).
Every partition packs on its own: no shuffle, and a partition that is computed again
gives the same rows. Bins that a partition leaves half full are split by powers of two.

Cases: a null or empty text is its end-of-document id alone; repeated rows, and rows
whose id is null or repeated, are packed as rows of their own; pieces of equal length go
in the order of their rows; long texts are tokenised whole, and no text is taken for the
end id; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batched, lean

CAPACITY = 4096
#: Exact power-of-two pieces are not cut shorter than this; the rest is one tail.
MIN_PIECE = 64
END_ID = 2
#: Distinct words that a worker remembers with their ids.
CACHE_WORDS = 400_000
#: As many at most once a task is over: a worker goes on to other steps, which need that memory.
KEPT_WORDS = 50_000
#: Texts, and bytes of them, whose words are looked up together.
BATCH_TEXTS = 4096
BATCH_BYTES = 1 << 20
#: New words of letters that the tokenizer gets as one text.
JOINED_WORDS = 100
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"
#: After a letter or digit: where a new word of the tokenizer begins in any case.
PUNCTUATION = b".,;:!?|%$&#*"
# by Latin-1 letter: lower case with plain white space as a space, letters and digits, punctuation
_LATIN = bytes(range(256)).decode("latin-1")
_LOWER = re.sub(r"[\n\t\r]", " ", _LATIN.lower()).encode("latin-1")
_WORDLY = np.array([c.isalnum() for c in _LATIN])
_MARK = np.isin(np.arange(256), list(PUNCTUATION))


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space and never joins across it.

    Words repeat, so each distinct one is encoded once and its ids are remembered in one
    flat array. A run of plain punctuation after a letter or digit is a word of its own to
    this tokenizer, so it is looked up apart; Latin-1 texts are looked up in lower case, as
    bytes with the space behind them, and only once for all texts of a call.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: by id: whether a word ends there
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        """Forgets all words."""
        self.known: dict = {"": 0, b" ": 0}
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)
        self.used, self.n = 0, 1

    def _put(self, words: list, ids: np.ndarray, size: np.ndarray) -> None:
        """Remembers new words; ``ids`` of one after another, ``size`` of each."""
        n, used = self.n + len(words), self.used + len(ids)
        if n > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * n), np.resize(self.size, 2 * n)
        if used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * used)
        self.flat[self.used : used] = ids
        self.begin[self.n : n], self.size[self.n : n] = self.used + np.cumsum(size) - size, size
        self.known.update(zip(words, range(self.n, n)))
        self.used, self.n = used, n

    def _learn(self, words: list) -> None:
        texts = [w[:-1].decode("latin-1") if isinstance(w, bytes) else w for w in words]
        # one word of letters is one word of the tokenizer, whose last id tells its end
        plain, single = [], []
        for i, w in enumerate(words):
            (plain if isinstance(w, bytes) and texts[i].isalpha() else single).append(i)
        for k in range(0, len(plain), 64 * JOINED_WORDS):
            parts = [plain[j : j + JOINED_WORDS] for j in range(k, min(k + 64 * JOINED_WORDS, len(plain)), JOINED_WORDS)]
            for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in part]) for part in parts], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(part) and ends[-1] == len(ids):
                    self._put([words[i] for i in part], ids, np.diff(ends, prepend=0))
                else:
                    single += part
        for k in range(0, len(single), 4096):
            part = single[k : k + 4096]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)]
            self._put([words[i] for i in part], np.array([x for own in ids for x in own], np.uint32), np.array([len(own) for own in ids], np.int64))

    def _numbers(self, words: list) -> np.ndarray:
        """Places of the words among the remembered ones."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(missed := np.flatnonzero(at < 0)):
            new = [words[i] for i in missed.tolist()]
            self._learn(list(dict.fromkeys(new)))
            at[missed] = [self.known[w] for w in new]
        return at

    def _latin(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of all texts, each closed by ``end``, and their counts."""
        # no line end is left in a text, so as a word it can stand for the text's end
        raw = np.frombuffer(b"".join([x for t in texts for x in (t.translate(_LOWER), b" \n ")]), np.uint8)
        raw = np.insert(raw, np.flatnonzero(_MARK[raw[1:]] & _WORDLY[raw[:-1]]) + 1, 32)
        offsets = np.append(0, np.flatnonzero(raw == 32) + 1)
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        which, closing = words.indices.to_numpy(), distinct.index(b"\n ")
        distinct[closing] = b" "
        at = self._numbers(distinct)
        at[closing] = end
        return at[which], np.diff(np.flatnonzero(which == closing), prepend=-1)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after another, each closed by ``end_id``; tokens of each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.n > CACHE_WORDS:
            self.clear()
        end = (end_id,)  # no text, so no word of a text is taken for it
        if end not in self.known:
            self._put([end], np.array([end_id], np.uint32), np.ones(1, np.int64))
        latin: list[bytes] = []
        latin_at, other_at, words, counts = [], [], [], []
        for i, t in enumerate(texts):
            t = t or ""
            try:
                if "<|" in t:
                    raise ValueError
                latin.append(t.encode("latin-1"))  # lower case and composition of these letters commute
                latin_at.append(i)
            except ValueError:  # of other letters too
                # only these white-space characters are taken out here; the tokenizer itself judges rarer ones
                own = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                words += own
                words.append(end)
                counts.append(len(own) + 1)
                other_at.append(i)
        at, n = self._latin(latin, self.known[end]) if latin else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if words:
            at, n, text = np.append(at, self._numbers(words)), np.append(n, counts), np.array(latin_at + other_at)
            at = at[np.argsort(np.repeat(text, n), kind="stable")]
            n = n[np.argsort(text)]
        size = self.size[at]
        shift = self.begin[at] - np.cumsum(size) + size
        where = np.repeat(shift, size)
        where += np.arange(len(where))
        return self.flat[where], np.add.reduceat(size, np.cumsum(n) - n)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker and file, for all its tasks."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut_lengths(n: int, capacity: int = CAPACITY, least: int = MIN_PIECE) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in order."""
    out = [capacity] * (n // capacity)
    n, half = n % capacity, capacity // 2
    while half >= least:
        if n >= half:
            out.append(half)
            n -= half
        half //= 2
    return out + [n] * (n > 0)


class Bins:
    """The open bins of one partition; at most one for each class."""

    def __init__(self, partition: int, capacity: int) -> None:
        self.capacity, self.next_id = capacity, partition << 33
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple]:
        k = self.capacity // piece[2]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        return self.close(self.open.pop(k)) if len(bin_) == k else []

    def close(self, pieces: list[tuple]) -> list[tuple]:
        total = sum(p[2] for p in pieces)
        padded = total if total & (total - 1) == 0 else self.capacity
        rows, offset = [], 0
        for p in pieces:
            rows.append((*p, self.next_id, offset, total, padded))
            offset += p[2]
        self.next_id += 1
        return rows

    def rest(self) -> list[tuple]:
        """Half-full bins. Equal power-of-two pieces go by powers of two; the tails of all
        classes are put together, as many as fit."""
        rows, tails = [], []
        for k in sorted(self.open):
            pieces = self.open[k]
            if k & (k - 1) == 0 and all(p[2] * k == self.capacity for p in pieces):
                while pieces:
                    n = 1 << (len(pieces).bit_length() - 1)
                    rows += self.close(pieces[:n])
                    pieces = pieces[n:]
            else:
                tails += pieces
        bin_, total = [], 0
        for p in tails:
            if total + p[2] > self.capacity:
                rows += self.close(bin_)
                bin_, total = [], 0
            bin_.append(p)
            total += p[2]
        self.open = {}
        return rows + (self.close(bin_) if bin_ else [])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, min_piece: int = MIN_PIECE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids as ``ids array<long>``."""
    schema = PIECE + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        bins = Bins(TaskContext.get().partitionId(), capacity)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * (len(names) + 1)
            out = [pa.array(c, pa.int64()) for c in (cols[0], cols[1], cols[2], cols[3], cols[4], *cols[-4:])]
            return pa.RecordBatch.from_arrays(out + [pa.array(cols[5], pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

        for part in batched(batches, BATCH_TEXTS, column=1, most_bytes=BATCH_BYTES):
            ids, counts = words.encode(part.column(1).to_pylist(), end_id)
            raw = ids.astype("<u4").tobytes()
            rows, at = [], 0
            for doc, n in zip(part.column(0).to_pylist(), counts.tolist()):
                start = 0
                for length in cut_lengths(n, capacity, min_piece):
                    crc = zlib.crc32(raw[4 * at : 4 * (at + length)])
                    rows += bins.add((doc, start, length, crc, n, ids[at : at + length].astype(np.int32) if with_ids else None))
                    start, at = start + length, at + length
            if rows:
                yield batch_of(rows)
        if rows := bins.rest():
            yield batch_of(rows)
        if words.n > KEPT_WORDS:
            words.clear()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), schema)
