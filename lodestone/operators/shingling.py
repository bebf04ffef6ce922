"""Sets of word shingles as 64-bit numbers, made for many texts at once.

Every word is hashed by SipHash; a shingle folds the hashes of its words. Helpers of Arrow
UDFs take a batch's texts a few at a time, so that no more words than those are held as
objects.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts, and characters of them, whose words are held at once.
TEXTS, CHARS = 256, 1 << 20
# fixed values: odd multipliers of the fold and of short texts
FOLD, SHORT, MASK = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D, (1 << 64) - 1


def _hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _some_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    # of bytes: A-Z are made lower case, white space of ASCII parts words
    held = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(x) for x in held], np.int64)
    hashes = _hashes([w for x in held for w in x])
    doc, first = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts) - counts
    whole = np.arange(len(hashes)) - first[doc] + words <= counts[doc]
    value = np.zeros(len(hashes), np.uint64)
    for j in range(words):
        value *= np.uint64(FOLD)
        value[: max(0, len(value) - j)] += hashes[j:]
    value = _mixed(value)
    for d in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        part = int(counts[d]) * SHORT & MASK
        for h in hashes[first[d] : first[d] + counts[d]].tolist():
            part = (part * FOLD + h) & MASK
        value[first[d]] = _mixed(np.array([part ^ SHORT], np.uint64))[0]
        whole[first[d]] = True
    value, doc = value[whole].view(np.int64), doc[whole]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[fresh], np.bincount(doc[fresh], minlength=len(texts))


def text_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, one text after another and each in ascending
    order, and how many there are. A text of fewer words is one shingle of all of them;
    null texts and those without words have none."""
    values, counts, some, chars = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
    for i, t in enumerate(t for k in range(0, len(texts), TEXTS) for t in texts.slice(k, TEXTS).to_pylist()):
        some.append(t)
        chars += len(t or "")
        if len(some) >= TEXTS or chars >= CHARS or i + 1 == len(texts):
            value, count = _some_sets(some, words)
            values.append(value)
            counts.append(count)
            some, chars = [], 0
    return np.concatenate(values), np.concatenate(counts)


def shingle_sets(text: Column, words: int = 5) -> Column:
    """Distinct runs of ``words`` words (A-Z made lower case) as numbers, in order; a shorter
    text is one run, one without words has none."""

    @F.arrow_udf("array<bigint>")
    def made(texts: pa.Array) -> pa.Array:
        values, counts = text_sets(texts, words)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))

    return made(text)


def shingle_marks(text: Column, words: int = 5) -> Column:
    """A digest of the set of shingles, null where it is empty."""

    @F.arrow_udf("binary")
    def made(texts: pa.Array) -> pa.Array:
        values, counts = text_sets(texts, words)
        ends = np.cumsum(counts).tolist()
        return pa.array([hashlib.blake2b(values[e - n : e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends, counts.tolist())], pa.binary())

    return made(text)
