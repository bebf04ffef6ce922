"""Prefix-free parsing of texts by rolling-hash triggers, many texts at a time, and the
suffix order of strings to a stated depth."""

from __future__ import annotations

import hashlib
from functools import cache
from typing import NamedTuple

import numpy as np

from .shingles import mixed

#: Bytes of a trigger string.
TRIGGER = 32
#: Low bits of a packed (hash, place) pair that hold the place.
PLACE_BITS = 22
#: Starts that are parsed together; a longer text goes in overlapping pieces.
PIECE = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, up to n of each."""
    inverse = pow(_ODD, -1, 1 << 64)
    out = []
    for base in (_ODD, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Phrases(NamedTuple):
    """Phrases in text order. A phrase is the text under ``starts`` consecutive windows,
    so neighbours overlap by a window less one byte and every window is in one phrase."""

    doc: np.ndarray
    begin: np.ndarray  # in the document
    starts: np.ndarray
    offset: np.ndarray  # of the trigger in the phrase
    trigger: np.ndarray
    name: np.ndarray  # two halves of a 128-bit hash of the phrase's bytes


def trigger_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A rolling hash of every ``size`` bytes. It only chooses triggers: strings that
    share one by mistake are compared more often, never taken as equal."""
    power, inverse = _powers(1 << max(19, len(codes).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[codes] * power[: len(codes)], dtype=np.uint64)])
    return mixed((total[size:] - total[:-size]) * inverse[: len(codes) - size + 1])


def triggers(codes: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window the place of its trigger: the string of ``size`` bytes with the
    smallest hash (the last one of equals); and all those hashes."""
    gram = trigger_hashes(codes, size)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = (gram & ~mask) | (mask - np.arange(len(gram), dtype=np.uint64))
    wide, have = window - size + 1, 1
    while 2 * have <= wide:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < wide:
        least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
    return (mask - (least & mask)).astype(np.int64), gram


def pieces(texts: list[bytes], window: int):  # noqa: ANN201
    """Lists of (document, begin in it, bytes): texts up to PIECE bytes in all, longer
    ones cut with an overlap of a window less one."""
    held, size = [], 0
    for d, t in enumerate(texts):
        if len(t) < window:
            continue
        for k in range(0, len(t) - window + 1, PIECE):
            part = t[k : k + PIECE + window - 1]
            if held and size + len(part) > PIECE + window:
                yield held
                held, size = [], 0
            held.append((d, k, part))
            size += len(part)
    if held:
        yield held


def parse(texts: list[bytes], window: int, trigger: int = TRIGGER) -> Phrases:
    out = []
    for held in pieces(texts, window):
        raw = b"".join(p for _, _, p in held)
        codes = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(p) for _, _, p in held])
        first = np.cumsum(sizes) - sizes
        where, gram = triggers(codes, window, trigger)
        part = np.repeat(np.arange(len(held)), sizes)[: len(where)]
        start = np.flatnonzero(np.arange(len(where)) + window <= (first + sizes)[part])
        where, part = where[start], part[start]
        edge = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (part[1:] != part[:-1])]))
        count = np.diff(np.append(edge, len(start)))
        begin, of, at = start[edge], part[edge], where[edge]
        digest = hashlib.blake2b
        name = b"".join([digest(raw[b:e], digest_size=16).digest() for b, e in zip(begin.tolist(), (begin + count + window - 1).tolist())])
        docs, offsets = np.array([d for d, _, _ in held]), np.array([k for _, k, _ in held])
        out.append((docs[of], begin - first[of] + offsets[of], count, at - begin, gram[at], np.frombuffer(name, "<u8").reshape(-1, 2)))
    if not out:
        return Phrases(*[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64))
    return Phrases(*[np.concatenate(c) for c in zip(*out)])


def suffix_ranks(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes of at least ``depth`` bytes by their first ``depth``
    bytes, exactly, by doubling: a rank for every place of the joined strings (-1 for
    shorter suffixes), and whether another one has the same. Places that are alone at
    some depth are not sorted again."""
    codes = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    n = len(codes)
    # 32 bits hold any place: a column of bytes is shorter than 2^31
    left = np.repeat(np.cumsum(sizes).astype(np.int32), sizes)
    left -= np.arange(n, dtype=np.int32)
    have = min(8, depth)
    key = np.zeros(n, np.uint64)
    for j in range(have):
        key[: n - j] |= codes[j:].astype(np.uint64) << np.uint64(8 * (7 - j))
    rank = np.full(n, -1, np.int32)
    tied = np.flatnonzero(left >= have).astype(np.int32)
    base = np.zeros(len(tied), np.int32)
    value = key[tied]
    del key
    while True:
        order = np.argsort(value, kind="stable")
        tied, base, value = tied[order], base[order], value[order]
        del order
        place = np.arange(len(tied), dtype=np.int32)
        fresh = np.ones(len(tied), bool)
        fresh[1:] = base[1:] != base[:-1]
        group = np.maximum.accumulate(np.where(fresh, place, np.int32(0)))
        fresh[1:] |= value[1:] != value[:-1]
        rank[tied] = base + np.maximum.accumulate(np.where(fresh, place, np.int32(0))) - group
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        if have == depth:
            break
        step = min(have, depth - have)
        tied = tied[left[tied] >= have + step]
        base = rank[tied]
        value = (base.astype(np.int64) << 32) | rank[tied + step]
        have += step
    rank[left < depth] = -1
    shared = np.zeros(n, bool)
    shared[tied] = True
    return rank, shared
