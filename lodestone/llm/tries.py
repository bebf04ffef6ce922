"""Collocations of words from depth-limited count tries.

Every shard (a task's texts of one language) makes a count trie of all runs of up to
``DEPTH`` words inside a piece: nodes in sorted order, each with its path and its count. The
sorted trie is cut at the same prefixes in all shards and each cut is sent, serialised, to
the range that owns it. A range merges its sorted tries into one and walks it: the stack of
a walk holds the counts of all left parts of a node. The nodes above a cut travel with
every piece below it, so a walk that begins in the middle of a frequent prefix knows its
left parts too, and no prefix, however frequent, has to be in one range. Right parts are
found by suffix links: the link of a node is the node without the first word, which a join
of nodes with nodes gives level by level. Parts of a phrase are at least as frequent as the
phrase, so only nodes that are frequent enough leave a range.

Cut prefixes steer balance alone. They are quantiles of the nodes of ``SAMPLE_DOCS`` texts
(smallest hashes), the number of ranges grows with the bytes of text.

Cases: null and empty texts have no words; a null language is ``und``; repeated rows, and
rows without an id, count as often as they stand there; a piece of one word has no phrase;
long texts are read whole, in several tries; equal scores and counts go by the bytes of the
phrase; other columns are not read, whatever their names; an empty table, or a language
without candidates, gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, keep

DEPTH, LEAST_COUNT, TOP = 3, 10, 2000
#: 100 times a longer phrase's count reaches so many times a shorter one's: it is dropped.
SHARE = 50
SAMPLE_DOCS = 3000
#: Parts of a language that are ranked apart before their best are.
PARTS = 128
#: Texts longer than this do not help to place cuts.
SAMPLE_CHARS = 50_000
#: Nodes that shards send to a range, by about so many a byte of text.
RANGE_NODES, NODES_A_BYTE = 1_500_000, 0.4
#: Words of a language, and distinct words of all, from which a task makes a trie; bytes of
#: a text that are taken at once.
SHARD_WORDS, SHARD_DISTINCT, SLICE = 1_500_000, 1_000_000, 1 << 20
# fixed values: what ends a piece
ENDS = b".,;:!?\n\x0b\x0c\r"
STOP = b"."
AS_STOP = bytes.maketrans(ENDS, STOP * len(ENDS))
SENT = "range int, lang string, words binary, nodes binary"
NODE = "lang string, depth int, phrase string, a long, left array<long>"

Path = tuple[bytes, ...]


def tokens_of(text: bytes) -> Iterator[list[bytes]]:
    """Words, with a full stop (no word holds one) wherever a piece ends and after the
    text, in slices; A-Z in lower case. All other blanks are ends of pieces."""
    low = text.lower().translate(AS_STOP).replace(STOP, b" . ") + b" . "
    at = 0
    while at < len(low):
        end = low.find(b" ", at + SLICE) + 1 or len(low)
        yield low[at:end].split()
        at = end


class Stream:
    """Words of one language as numbers, text after text."""

    def __init__(self) -> None:
        self.clear([])

    def clear(self, words: list[bytes]) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.parts, self.size = [], 0
        self.add(words)

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def trie(self, depth: int, ended: bool) -> Trie:
        """The trie of what was added. Unless it ``ended``, the last words begin no phrase
        yet: they begin the next trie."""
        text, words = np.concatenate(self.parts), list(self.numbers)
        carried = 0 if ended else min(depth - 1, len(text))
        order = sorted(w for w in words if w != STOP)
        rank = {w: i for i, w in enumerate(order)}
        text_ = np.fromiter((rank.get(w, -1) for w in words), np.int32, len(words))[text]
        self.clear([words[i] for i in text[len(text) - carried :].tolist()])
        return Trie.of(order, text_, depth, len(text) - carried)


class Trie:
    """Nodes in sorted order: paths of ``depth`` word numbers (-1 below a node's own depth)
    and counts. Words are numbered in the order of their bytes; the root comes first."""

    def __init__(self, words: list[bytes], paths: np.ndarray, counts: np.ndarray) -> None:
        self.words, self.paths, self.counts = words, paths, counts

    @staticmethod
    def of(words: list[bytes], text: np.ndarray, depth: int, starts: int) -> Trie:
        """``text``: word numbers, -1 where a piece ends; phrases begin in its first ``starts``."""
        base = len(words) + 1
        here = text.astype(np.int64) + 1
        key, inside = here[:starts], here[:starts] > 0
        levels = [(np.zeros(1, np.int64), np.array([int(inside.sum())]))]
        for level in range(1, depth + 1):
            if level > 1:
                ahead = here[level - 1 : starts + level - 1]
                key, inside = key[: len(ahead)] * base + ahead, inside[: len(ahead)] & (ahead > 0)
            found, counts = np.unique(key[inside], return_counts=True)
            levels.append((found * base ** (depth - level), counts))
        key, counts = (np.concatenate(x) for x in zip(*levels))
        order = np.argsort(key, kind="stable")
        return Trie(words, _unpacked(key[order], base, depth), counts[order])

    def path(self, i: int) -> Path:
        return tuple(self.words[n] for n in self.paths[i].tolist() if n >= 0)

    def place(self, path: Path) -> int:
        """The first node that is not before ``path``."""
        return bisect_left(range(len(self.counts)), path, key=self.path)

    def cut(self, cuts: list[Path]) -> Iterator[tuple[int, Trie]]:
        """The part before each cut and the part after the last. The nodes above a cut come
        again, with negative counts, at the head of the part that begins there."""
        edges = [0, *(self.place(c) for c in cuts), len(self.counts)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            above = []
            for n in range(len(cuts[k - 1]) if k else 0):
                at = self.place(cuts[k - 1][:n])
                if at < len(self.counts) and self.path(at) == cuts[k - 1][:n]:
                    above.append(at)
            if a < b or above:
                some = np.concatenate([np.array(above, np.int64), np.arange(a, b)])
                counts = self.counts[some]
                counts[: len(above)] *= -1
                used, renumbered = np.unique(np.append(self.paths[some].ravel(), -1), return_inverse=True)
                words = [self.words[i] for i in used[1:].tolist()]
                yield k, Trie(words, (renumbered[:-1] - 1).reshape(-1, self.paths.shape[1]).astype(np.int32), counts)

    def dump(self) -> tuple[bytes, bytes]:
        """Words, and level by level the numbers of paths and then counts, compressed."""
        raw = [b" ".join(self.words), self.paths.T.tobytes() + self.counts.astype(np.int64).tobytes()]
        return tuple(len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in raw)

    @staticmethod
    def load(words: bytes, nodes: bytes, depth: int) -> Trie:
        words, nodes = (pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in (words, nodes))
        n = len(nodes) // (4 * depth + 8)
        paths = np.frombuffer(nodes, np.int32, n * depth).reshape(depth, n).T
        return Trie(words.split(b" ") if words else [], paths, np.frombuffer(nodes, np.int64, n, 4 * n * depth))

    @staticmethod
    def merged(tries: list[Trie]) -> Trie:
        """One trie with the counts of all."""
        words = sorted(set().union(*(t.words for t in tries)))
        rank = {w: i for i, w in enumerate(words)}
        base, depth = len(words) + 1, tries[0].paths.shape[1]
        paths = np.concatenate([np.array([*map(rank.__getitem__, t.words), -1], np.int32)[t.paths] for t in tries])
        counts = np.concatenate([t.counts for t in tries])
        if base**depth < 1 << 63:
            key = np.zeros(len(paths), np.int64)
            for level in range(depth):
                key = key * base + paths[:, level] + 1
            order = np.argsort(key, kind="stable")
            new = np.diff(key[order], prepend=-1) != 0
        else:
            order = np.lexsort(paths.T[::-1])
            new = np.append(True, (np.diff(paths[order], axis=0) != 0).any(1))
        first = np.flatnonzero(new)
        return Trie(words, paths[order[first]], np.add.reduceat(counts[order], first))

    def walk(self, least: int) -> Iterator[pa.RecordBatch]:
        """Nodes of a part (not those above it) with ``least`` occurrences, and the root:
        depth, phrase, count and the counts of its left parts."""
        depth = (self.paths >= 0).sum(1)
        most = self.paths.shape[1]
        count, each = np.abs(self.counts), np.arange(len(self.counts))
        # the stack of the walk: the last node of each depth
        stack = [np.maximum.accumulate(np.where(depth == k, each, 0)) for k in range(1, most)]
        found = np.flatnonzero((self.counts >= least) | ((depth == 0) & (self.counts > 0)))
        for some in (found[i : i + 50_000] for i in range(0, len(found), 50_000)):
            left = np.stack([count[s[some]] for s in stack], 1) if stack else np.zeros((len(some), 0), np.int64)
            inside = np.arange(1, most)[None, :] < depth[some][:, None]
            phrases = [b" ".join(self.path(i)) for i in some.tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(inside.sum(1))).astype(np.int32)), pa.array(left[inside]))
            yield pa.RecordBatch.from_arrays([pa.array(depth[some].astype(np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(count[some]), lists], names=["depth", "phrase", "a", "left"])


def _unpacked(key: np.ndarray, base: int, depth: int) -> np.ndarray:
    out = np.empty((len(key), depth), np.int32)
    for level in range(depth - 1, -1, -1):
        out[:, level] = key % base - 1
        key = key // base
    return out


def shards(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[str, Trie]]:
    """Tries of the texts of a task (``lang, text``), language by language."""
    held: defaultdict[str, Stream] = defaultdict(Stream)
    most = min(SHARD_WORDS, int(2 ** (62.5 / depth)) // 2)  # paths are packed in 63 bits
    for b in batched(batches, 4096, column=1):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for words in tokens_of(text):
                held[lang].add(words)
                if held[lang].size >= most:
                    yield lang, held[lang].trie(depth, ended=False)
        if sum(len(s.numbers) for s in held.values()) >= SHARD_DISTINCT:
            for lang in list(held):
                yield lang, held.pop(lang).trie(depth, ended=True)
    for lang in list(held):
        yield lang, held.pop(lang).trie(depth, ended=True)


def cuts_of(texts: DataFrame, depth: int, range_nodes: int) -> list[tuple[str, Path]]:
    """Prefixes, in order, that cut the nodes of a bounded sample into equal parts."""
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = ceil(NODES_A_BYTE * (size["bytes"] or 0) / range_nodes)
    if ranges < 2:
        return []

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = sorted((lang, trie.path(i)) for lang, trie in shards(batches, depth) for i in range(0, len(trie.counts), 8))
        some = sorted({nodes[len(nodes) * k // ranges] for k in range(1, ranges)}) if nodes else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.string()), pa.array([list(p) for _, p in some], pa.list_(pa.binary()))], names=["lang", "path"])

    hashed = F.pmod(F.xxhash64("lang", "text", "salt"), F.lit(size["n"])) < SAMPLE_DOCS
    sample = texts.where(F.octet_length("text") < SAMPLE_CHARS).withColumn("salt", F.monotonically_increasing_id()).where(hashed).drop("salt").limit(2 * SAMPLE_DOCS)
    rows = sample.repartition(1).mapInArrow(sampled, "lang string, path array<binary>").collect()  # a path for each range
    return [(r["lang"], tuple(bytes(w) for w in r["path"])) for r in rows]


def frequent_nodes(texts: DataFrame, depth: int, least: int, range_nodes: int) -> DataFrame:
    """``NODE`` rows of the whole trie of ``texts`` (``lang, text`` as bytes)."""
    cuts = cuts_of(texts, depth, range_nodes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, trie in shards(batches, depth):
            first, last = bisect_left(cuts, (lang,)), bisect_left(cuts, (lang + "\0",))
            parts = [(first + k, lang, *t.dump()) for k, t in trie.cut([p for _, p in cuts[first:last]])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["range", "lang", "words", "nodes"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[tuple[int, str], list[Trie]] = defaultdict(list)
        for b in batches:
            for k, lang, words, nodes in zip(*(c.to_pylist() for c in b.columns)):
                tries = held[k, lang]
                tries.append(Trie.load(words, nodes, depth))
                if sum(len(t.counts) for t in tries[1:]) > range_nodes:
                    held[k, lang] = [Trie.merged(tries)]
        for (_, lang), tries in held.items():
            for out in Trie.merged(tries).walk(least):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * out.num_rows, pa.string()), *out.columns], names=[c.split()[0] for c in NODE.split(", ")])

    return texts.mapInArrow(send, SENT).repartitionById(len(cuts) + 1, F.col("range")).mapInArrow(merge, NODE)


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST_COUNT, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text", range_nodes: int = RANGE_NODES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of 2 to ``depth`` words
    of every language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    nodes = keep(frequent_nodes(texts, depth, least, range_nodes), "trie-nodes")
    at = lambda k: nodes.where(F.col("depth") == k)
    without_first = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    without_last = F.expr("substring(phrase, 1, length(phrase) - instr(reverse(phrase), ' '))")
    # suffix links, level by level: right parts of a node are its link and the link's own
    linked = at(1).select("lang", "phrase", "a", F.array().cast("array<long>").alias("right"))
    levels = []
    for k in range(2, depth + 1):
        link = linked.select("lang", F.col("phrase").alias("link"), F.concat(F.array("a"), "right").alias("right"))
        linked = at(k).withColumn("link", without_first).join(link, ["lang", "link"]).select("lang", "phrase", "a", "left", "right")
        levels.append(linked)
    cut = F.expr("transform(arrays_zip(left, right), (x, i) -> struct((cast(a as decimal(19,0)) * a * 1000000) div (cast(x.left as decimal(19,0)) * x.right) as score, i as k, x.left as l, x.right as r))")
    found = []
    for k, level in enumerate(levels, start=2):
        scored = level.select("lang", "phrase", "a", F.array_min(cut).alias("cut"))
        if k < depth:
            longer = at(k + 1)
            parts = longer.select("lang", without_last.alias("phrase"), F.col("a").alias("most")).unionByName(longer.select("lang", without_first.alias("phrase"), F.col("a").alias("most")))
            most = parts.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
            scored = scored.join(most, ["lang", "phrase"], "left").where(F.expr(f"most is null or 100 * cast(most as decimal(19,0)) < {share} * cast(a as decimal(19,0))")).drop("most")
        found.append(scored)
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    # the best of every part of a language first, so that no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order))
    few = both.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", part).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    # the root of each language, one for every range that it begins in, has all its words
    roots = at(0).groupBy("lang").agg(F.sum("a").alias("n"))
    return best.join(roots, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def duckdb_sql(least: int = LEAST_COUNT, share: int = SHARE, top: int = TOP) -> str:
    """The same rows (runs of up to three words) in DuckDB's SQL."""
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (
  SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents)),
o AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM p UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
t AS (SELECT lang, count(*) AS n FROM o WHERE m = 1 GROUP BY 1),
f AS (SELECT lang, m, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM o GROUP BY 1, 2, 3 HAVING count(*) >= {least}),
c AS (SELECT f.lang, f.phrase, f.m, f.a, k.k, x.a AS l, y.a AS r, ((f.a::HUGEINT * f.a * 1000000) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM f JOIN (SELECT unnest([1, 2]) AS k) k ON k.k < f.m JOIN f x ON x.lang = f.lang AND x.phrase = array_to_string(f.w[1:k.k], ' ') JOIN f y ON y.lang = f.lang AND y.phrase = array_to_string(f.w[k.k + 1:], ' ')),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM f WHERE m = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM f WHERE m = 3) GROUP BY 1, 2),
b AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, encode(s.phrase)) AS rank FROM s LEFT JOIN d USING (lang, phrase) WHERE d.most IS NULL OR 100 * d.most < {share} * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM b JOIN t USING (lang) WHERE rank <= {top}"""
