"""Sets of word shingles as 128-bit hashes, made for many texts at once.

Every distinct word is hashed by keyed BLAKE2b to two 64-bit halves; a shingle folds the
halves of its words in two lanes with different multipliers. Words are thus independent
of how they are spelt, so no pair of texts can be built to collide without breaking the
hash: among n distinct shingles two agree with a chance of n^2 / 2^129 or so (10^13
shingles: 10^-13).
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np

WORDS = 5
#: Bytes of text whose words are looked up at once; a piece ends at white space.
PIECE = 1 << 20
#: Bytes of words that a worker remembers with their hashes.
REMEMBERED = 1 << 21
KEY = b"word shingles"
SPACE = re.compile(rb"[\x20\x09-\x0D]")
# fixed values: odd multipliers of the two lanes
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SHORT = 0x5851F42D4C957F2D


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Words:
    """Hashes of words; those of earlier texts are remembered."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.both = np.zeros((1 << 12, 2), np.uint64)
        self.size = 0

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """One row of two halves for every word."""
        if self.size > REMEMBERED:
            self.clear()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(missed := np.flatnonzero(at < 0)):
            new = list({words[i] for i in missed.tolist()})
            raw = b"".join(hashlib.blake2b(w, digest_size=16, key=KEY).digest() for w in new)
            n, self.size = len(self.known), self.size + sum(map(len, new))
            if n + len(new) > len(self.both):
                self.both = np.resize(self.both, (2 * (n + len(new)), 2))
            self.both[n : n + len(new)] = np.frombuffer(raw, "<u8").reshape(-1, 2)
            self.known.update(zip(new, range(n, n + len(new))))
            at[missed] = [self.known[words[i]] for i in missed.tolist()]
        return self.both[at]


_words = Words()


def _pieces(raw: bytes) -> list[bytes]:
    """A text in pieces of PIECE bytes or little more, cut at white space."""
    out, at = [], 0
    while len(raw) - at > PIECE:
        gap = SPACE.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the hash of every word (only A-Z made lower case) of all texts, and
    the number of words in each text."""
    out, held, counts = [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        for part in _pieces((t or "").encode("utf-8", "surrogatepass")):
            own = part.lower().split()  # of bytes: ASCII letters and ASCII white space only
            counts[i] += len(own)
            held += own
            if len(held) > 1 << 17:
                out.append(_words.hashes(held))
                held = []
    out.append(_words.hashes(held))
    return np.concatenate(out), counts


def order_of(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The ascending order of 128-bit numbers; the low halves decide hardly ever."""
    order = np.argsort(hi, kind="stable")
    h, low = hi[order], lo[order]
    if ((h[1:] == h[:-1]) & (low[1:] < low[:-1])).any():
        order = np.lexsort((lo, hi))
    return order


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low halves of the distinct shingles of every text, one text after another
    and each in ascending order, and how many there are. A text of fewer words is one
    shingle of all of them; without words there is none."""
    hashes, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    whole = np.arange(len(hashes)) - first[doc] + words <= counts[doc]
    lanes = []
    for lane, odd in enumerate(LANES):
        value = np.zeros(len(hashes), np.uint64)
        for j in range(words):
            value *= np.uint64(odd)
            value[: max(0, len(value) - j)] += hashes[j:, lane]
        lanes.append(mixed(value))
    for d in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        for lane, odd in enumerate(LANES):
            part = int(counts[d]) * _SHORT
            for h in hashes[first[d] : first[d] + counts[d], lane].tolist():
                part = (part * odd + h) & 0xFFFFFFFFFFFFFFFF
            lanes[lane][first[d]] = mixed(np.array([part ^ _SHORT], np.uint64))[0]
        whole[first[d]] = True
    hi, lo, doc = lanes[0][whole], lanes[1][whole], doc[whole]
    order = order_of(hi, lo)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
    hi, lo, doc = hi[order], lo[order], doc[order]
    fresh = np.ones(len(hi), bool)
    fresh[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (doc[1:] != doc[:-1])
    return hi[fresh], lo[fresh], np.bincount(doc[fresh], minlength=len(texts))
