"""Toxicity by a weighted finite-state pattern grammar over clauses.

The words of a clause become symbols: insult, threat, target, negation, reporting verb,
other. Transducers are then composed, each reading what the one before wrote: reported
speech marks what is said by someone else, negation marks the next words, and target
(run from either end) marks what is aimed at a person. Every insult or threat leaves as
one of a few marked symbols; a text's score is a weighted sum over its matched clauses.

The insult words and stems, their weights and the weights of the marked symbols are
learnt from a bounded sample of labelled rows (``TRAIN_ROWS``, smallest hashes of their
ids among the documents that are there), never from the held-out fifth. Counts of words
and stems and the features are made where the texts are; the driver gets entries that
mark toxic texts, and a row of features a text. A stem enters only for toxic texts that
no earlier entry explains, so the other words of a text that was copied often do not.
How often marks stand in a text counts too, as a stem may stand in a clean text by chance.

Cases: null and empty texts, and texts without a match, get the learnt base score;
several labels of a document: the largest counts; of texts that share an id the smallest
is learnt from; of equally good entries the more specific, then the later by code point,
is taken, so reruns agree; repeated rows get equal scores; long texts are read whole;
without labels only the fixed words count, with fixed weights; other columns are not
read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .linear import Logistic

TRAIN_ROWS = 12_000
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
#: A learnt entry must stand in so many toxic training texts that nothing else explains.
LEAST_TEXTS = 4
#: Least logarithm of how much likelier an entry stands in toxic texts than in clean ones.
LEAST_WEIGHT = 2.0
# fixed values: words of the grammar
INSULTS = "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown".split()
THREATS = "kill hurt destroy beat stab shoot burn hunt punish".split()
TARGETS = "you your yours u he she they them him her his this these those du dich dir dein ihr euch sie tu te toi vous votre il elle ils ustedes usted tú eres ellos".split()
NEGATIONS = "not never no nobody isn't aren't wasn't nicht kein keine nie pas jamais aucun nunca nadie ningún".split()
REPORTS = "said says say told reported quoted wrote claimed called according sagte sagt meinte dit disait selon dijo dice según".split()
CLAUSE = re.compile(r"[.!?;\n|]+")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Marked symbols, in the order of the features that count them.
MARKS = ("I", "Ir", "In", "It", "T", "Tr", "Tn", "Tt")
WIDTH = len(MARKS) + 3


class Transducer:
    """A deterministic transducer: (state, symbol) to (state, output symbol); where an arc
    is missing the symbol passes and the state goes to ``fall`` of itself."""

    def __init__(self, arcs: dict[tuple[str, str], tuple[str, str]], fall: dict[str, str] | None = None) -> None:
        self.arcs, self.fall = arcs, fall or {}

    def __call__(self, symbols: list[str]) -> list[str]:
        state, out = "0", []
        for s in symbols:
            state, o = self.arcs.get((state, s)) or (self.fall.get(state, state), s)
            out.append(o)
        return out


# once a reporting verb stands in a clause, what follows is someone else's word
REPORTED = Transducer({("0", "R"): ("r", "R"), ("r", "I"): ("r", "Ir"), ("r", "T"): ("r", "Tr")})
# a negation reaches over the next three words
NEGATED = Transducer(
    {(a, "N"): ("3", "N") for a in "0123"} | {(a, x): (str(int(a) - 1), x + "n") for a in "123" for x in "IT"},
    {"3": "2", "2": "1", "1": "0"},
)
# aimed at a person who is named before it in the clause; run backwards: after it
AIMED = Transducer({("0", "Y"): ("y", "Y"), ("y", "I"): ("y", "It"), ("y", "T"): ("y", "Tt")})


def compose(symbols: list[str]) -> list[str]:
    """The whole grammar: each transducer reads what the one before wrote."""
    return AIMED(AIMED(NEGATED(REPORTED(symbols)))[::-1])[::-1]


class Grammar:
    """Words with their symbols, stems with their weights, and the weights of the marks."""

    def __init__(self, entries: dict[str, float], model: Logistic | None = None) -> None:
        """``entries``: whole words with a leading "=", stems without."""
        self.entries, self.model = entries, model
        self._ready = None

    def __getstate__(self) -> dict:
        return {"entries": self.entries, "model": self.model, "_ready": None}

    def _build(self) -> None:
        import ahocorasick

        self._ready = ahocorasick.Automaton()
        self.longest = max(map(len, self.entries), default=0)
        for s in {*(e.removeprefix("=") for e in self.entries), *THREATS}:
            self._ready.add_word(s, len(s))
        self._ready.make_automaton()
        self.symbols = dict.fromkeys(THREATS, "T") | dict.fromkeys(TARGETS, "Y") | dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(REPORTS, "R")

    def _word(self, word: str) -> tuple[str, float]:
        if (w := self.entries.get("=" + word)) is not None:
            return "I", w
        for n in range(min(len(word), self.longest), 2, -1):
            if (w := self.entries.get(word[:n])) is not None:
                return "I", w
        return self.symbols.get(word, "o"), 0.0

    def features(self, text: str | None) -> np.ndarray:
        """Log counts of the marked symbols, the largest and the summed weight of the
        insults, and how many of them stand in a thousand characters."""
        if self._ready is None:
            self._build()
        out = np.zeros(WIDTH)
        low = (text or "").lower()
        at, weights = -1, []
        for end, n in self._ready.iter(low):
            begin = end - n + 1
            if begin <= at or (begin and low[begin - 1].isalpha()):
                continue
            # the clause that this match stands in, judged once
            # nothing before the end of the clause judged last matters, so no text is read twice
            left = max(low.rfind(c, max(at, 0), begin) for c in ".!?;\n|") + 1
            stop = CLAUSE.search(low, end)
            at = stop.start() if stop else len(low)
            words = [self._word(w) for w in TOKEN.findall(low[left:at])]
            for symbol, (_, weight) in zip(compose([s for s, _ in words]), words):
                if symbol in MARKS:
                    out[MARKS.index(symbol)] += 1
                    weights.append(weight)
        out[: len(MARKS)] = np.log1p(out[: len(MARKS)])
        if weights:
            out[-3:] = max(weights), np.log1p(sum(weights)), np.log1p(1000 * len(weights) / len(low))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.stack([self.features(t) for t in texts])
        if self.model is None:
            return np.where(x[:, : len(MARKS)].sum(1) > 0, 0.8, 0.05)
        return self.model.predict(x)


def entries_of(text: str) -> set[str]:
    """What a text may be known by: its words, and the beginnings of longer words."""
    words = set(TOKEN.findall(text.lower()))
    return {"=" + w for w in words} | {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n}


def cover(where: dict[str, set[int]], clean: dict[str, int], toxic: int, others: int) -> dict[str, float]:
    """Entries with weights: the one that explains most toxic texts is taken, those texts
    are set aside, and so on, until none explains ``LEAST_TEXTS`` more."""
    weight = {e: float(np.log((len(ids) + 0.5) / (toxic + 1)) - np.log((clean[e] + 0.5) / (others + 1))) for e, ids in where.items()}
    where = {e: ids for e, ids in where.items() if len(ids) >= LEAST_TEXTS and weight[e] > LEAST_WEIGHT}
    out: dict[str, float] = {}
    left = set().union(*where.values()) if where else set()
    while where:
        gain = {e: len(ids & left) for e, ids in where.items()}
        where = {e: ids for e, ids in where.items() if gain[e] >= LEAST_TEXTS}
        if where:
            best = max(where, key=lambda e: (gain[e] * weight[e], len(e), e))
            left -= where.pop(best)
            out[best] = weight[best]
    return out


COUNTED = "entry string, half int, toxic array<long>, clean long"


def entry_counts(sample: DataFrame) -> DataFrame:
    """``entry, toxic0, toxic1, clean0, clean1``: of both halves of the sample (``doc_id,
    half, y, text``) the toxic texts that hold an entry and the number of clean ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                ids, halves, ys, texts = (c.to_pylist() for c in b.slice(k, 500).columns)
                toxic, clean = defaultdict(list), Counter()
                for i, h, y, t in zip(ids, halves, ys, texts):
                    for e in entries_of(t):
                        if y:
                            toxic[e, h].append(i)
                        else:
                            clean[e, h] += 1
                keys = list({**toxic, **clean})
                cols = [[e for e, _ in keys], [h for _, h in keys], [toxic.get(x, []) for x in keys], [clean[x] for x in keys]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int64()))], names=["entry", "half", "toxic", "clean"])

    counted = sample.select("doc_id", "half", "y", "text").mapInArrow(count, COUNTED)
    of = lambda h: F.col("half") == h
    return counted.groupBy("entry").agg(
        *[F.flatten(F.collect_list(F.when(of(h), F.col("toxic")))).alias(f"toxic{h}") for h in (0, 1)],
        *[F.coalesce(F.sum(F.when(of(h), F.col("clean"))), F.lit(0)).alias(f"clean{h}") for h in (0, 1)],
    )


def train(docs: DataFrame, labels: DataFrame, label_col: str, train_rows: int) -> Grammar:
    usable = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    there = usable.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y")).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # train_rows rows of two numbers
    # entries from one half, the weights of the marks from the other, so that entries that
    # only happen to stand in toxic texts are not taken at their own word
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    sample = keep(text.groupBy("doc_id", "y").agg(F.min("text").alias("text")).withColumn("half", half), "toxicity-sample")
    fixed = {"=" + w: 3.0 for w in INSULTS}
    sizes = {(r["half"], r["y"] > 0): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    if not sizes:
        return Grammar(fixed)
    counts = keep(entry_counts(sample), "toxicity-counts")

    def learn(halves: tuple[int, ...]) -> dict[str, float]:
        ids, clean = F.concat(*[F.col(f"toxic{h}") for h in halves]), sum((F.col(f"clean{h}") for h in halves), F.lit(0))
        toxic, others = (sum(sizes.get((h, k), 0) for h in halves) for k in (True, False))
        weight = F.log((F.size("ids") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (others + 1))
        # entries that mark toxic texts: of train_rows texts at most
        rows = counts.select("entry", ids.alias("ids"), clean.alias("clean")).where((F.size("ids") >= LEAST_TEXTS) & (weight > LEAST_WEIGHT)).collect()
        return cover({r["entry"]: set(r["ids"]) for r in rows}, {r["entry"]: r["clean"] for r in rows}, toxic, others)

    grammar = Grammar(fixed | learn((0,)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [grammar.features(t).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    rows = sample.where("half = 1").select("y", "text").mapInArrow(features, "y int, x array<double>").collect()  # train_rows rows of WIDTH numbers at most
    rows.sort(key=lambda r: (r["y"], r["x"]))
    y = np.array([r["y"] > 0 for r in rows], np.float64)
    if 0 < y.sum() < len(y):
        # then with the entries of the whole sample
        return Grammar(fixed | learn((0, 1)), Logistic(penalty=0.3).fit(np.array([r["x"] for r in rows]), y))
    return grammar


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, in one pass."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    grammar = train(plain, labels, label_col, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                p = b.slice(k, 500)
                s = grammar.score(p.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return plain.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
