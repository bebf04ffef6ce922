"""How well a text may be cut behind each of its lines: seven factors by weights of the
language, and how deep the lines stand in curly brackets.

Everything is worked out over the array of a text's lines, beside the scan, without a
shuffle. Cases: null texts give no rows; an unknown or null language has the common
weights; the first line has nothing before it and the last nothing behind it; brackets
that close more than was opened count below zero.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import LINE_KINDS, is_kind
from ..functions.text import let, lookup, scan
from .chunking import Remembered, lines_of
from .code_quality import ASIDE, PAIRS, plain_code, symbol_balance
from .structure import _compiled

FACTORS = ("syntactic", "function", "class", "method", "import", "logical", "comment")
# fixed values: weights of languages in the order of the factors, and shares of the factors
COMMON = (0.7, 0.8, 0.8, 0.7, 0.7, 0.6, 0.4)
WEIGHTS = {
    "typescript": (0.8, 0.9, 0.9, 0.8, 0.7, 0.6, 0.4),
    "javascript": (0.8, 0.9, 0.9, 0.8, 0.7, 0.6, 0.4),
    "python": (0.7, 0.9, 0.9, 0.8, 0.8, 0.7, 0.5),
    "java": (0.8, 0.9, 0.9, 0.8, 0.8, 0.5, 0.4),
    "go": (0.7, 0.9, 0.7, 0.7, 0.8, 0.6, 0.4),
    "rust": (0.8, 0.9, 0.7, 0.8, 0.7, 0.6, 0.4),
    "cpp": (0.8, 0.9, 0.9, 0.8, 0.7, 0.6, 0.4),
    "c": (0.7, 0.9, 0.5, 0.7, 0.6, 0.6, 0.4),
    "csharp": (0.8, 0.9, 0.9, 0.8, 0.8, 0.5, 0.4),
    "scala": (0.8, 0.9, 0.8, 0.8, 0.7, 0.6, 0.4),
}
SHARES = (0.3, 0.4, 0.4, 0.35, 0.2, 0.5, 0.1)
#: Ends of blocks, of functions on one line and of functions without brackets; lines of
#: nothing but closing signs; lines that declare a variable.
CLOSED = r"^\}\s*;?\s*(?://.*)?$"
FUNCTION_CLOSED = CLOSED + r"|(?:=>|\bfunction\b.*\))\s*\{.*\}\s*;?$|^end(?:if|\s*function)?$"
ONLY_CLOSERS = r"^[\s\]});]*$"
SYMBOLS = r"[()\[\]{}`]"
DECLARED = r"^(?:const|let|var)\s+\w"
EXPORTED = r"^export\s"


def factors(line: Column, before: Column, behind: Column) -> Column:
    """The seven factors of a line as booleans; ``before`` and ``behind`` may be null."""
    trimmed = F.trim(F.translate(line, "\t\r", "  "))
    closed = trimmed.rlike(CLOSED)
    near = lambda test: F.coalesce(test(before), F.lit(False)), lambda test: F.coalesce(test(behind), F.lit(False))
    starts = lambda x: is_kind(x, "function") | is_kind(x, "class")
    declares = lambda x: F.trim(x).rlike(DECLARED)
    apart = near[0](starts) | near[1](starts) | (near[0](declares) & near[1](declares))
    tests = (
        ~trimmed.rlike(SYMBOLS) | trimmed.rlike(ONLY_CLOSERS) | symbol_balance(trimmed)["safe"], trimmed.rlike(FUNCTION_CLOSED), closed, closed,
        is_kind(line, "import") | trimmed.rlike(EXPORTED), (trimmed == "") & before.isNotNull() & behind.isNotNull() & apart, is_kind(line, "comment"),
    )
    return F.struct(*[t.alias(name) for name, t in zip(FACTORS, tests)])


def weights_of(language: Column) -> Column:
    return F.coalesce(lookup({k: F.array(*map(F.lit, v)) for k, v in WEIGHTS.items()}, F.lower(language), None), F.array(*map(F.lit, COMMON)))


def boundary_score(line: Column, before: Column, behind: Column, language: Column) -> Column:
    """0 to 1: how well a text may be cut behind a line."""
    weigh = lambda f, w: F.least(F.lit(1.0), sum((F.when(f[name], w[i] * share).otherwise(0.0) for i, (name, share) in enumerate(zip(FACTORS, SHARES))), F.lit(0.0)))
    return let(factors(line, before, behind), lambda f: let(weights_of(language), lambda w: weigh(f, w)))


# Java's own edge of a word takes letters of all scripts for parts of words
_java = lambda pattern: _compiled(pattern.replace(r"\b", r"(?u:\b)"))
_KINDS = {kind: _java("|".join(patterns)) for kind, patterns in LINE_KINDS.items()}
_CLOSED, _FUNCTION_CLOSED, _ONLY_CLOSERS, _SYMBOLS, _EXPORTED = map(_java, (CLOSED, FUNCTION_CLOSED, ONLY_CLOSERS, SYMBOLS, EXPORTED))
# the first of them says itself that a dot is any sign
_ASIDE = [re.compile(p, re.ASCII) if p.startswith("(?s)") else _java(p) for p in ASIDE]


def line_is(line: str, kind: str) -> bool:
    """``is_kind`` of one line."""
    return _KINDS[kind].search(line.strip(" ")) is not None


def _line_factors(line: str) -> tuple[bool, ...]:
    trimmed = line.translate({9: " ", 13: " "}).strip(" ")
    code = trimmed
    for pattern in _ASIDE:
        code = pattern.sub(" ", code)
    even = code.count("`") % 2 == 0 and all(code.count(a) == code.count(b) for a, b in PAIRS.values())
    closed = _CLOSED.search(trimmed) is not None
    return (
        even or not _SYMBOLS.search(trimmed) or _ONLY_CLOSERS.search(trimmed) is not None, _FUNCTION_CLOSED.search(trimmed) is not None, closed, closed,
        line_is(line, "import") or _EXPORTED.search(trimmed) is not None, False, line_is(line, "comment"),
    )


def _line_score(line: str, language: str | None) -> float:
    weights, score = WEIGHTS.get((language or "").lower(), COMMON), 0.0
    for is_so, weight, share in zip(_line_factors(line), weights, SHARES):
        score += weight * share if is_so else 0.0
    return min(1.0, score)


@functools.lru_cache(64)
def line_scores(language: str | None) -> Remembered:
    """``boundary_score`` of lines that have no neighbours, by line."""
    return Remembered(lambda line: _line_score(line, language))


def nesting(text: Column) -> Column:
    """How many curly brackets are open behind each line, strings and comments left out."""
    count = lambda x, sign: F.length(x) - F.length(F.translate(x, sign, ""))
    net = F.transform(lines_of(text), lambda x: F.when(x.rlike("[{}]"), let(plain_code(x), lambda c: count(c, "{") - count(c, "}"))).otherwise(0))
    return scan(net, F.lit(0), lambda s, x: s + x, lambda s: s, "int")


def boundary_lines(docs: DataFrame, language: Column, text_col: str = "text", keys: tuple = ("doc_id",)) -> DataFrame:
    """``keys, line`` (from 1), ``score`` and ``depth`` of every line."""
    def judged(lines: Column, depth: Column) -> Column:
        return F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), boundary_score(x, F.get(lines, i - 1), F.get(lines, i + 1), language).alias("score"), F.get(depth, i).alias("depth")))

    all_ = let(lines_of(F.col(text_col)), lambda lines: let(nesting(F.col(text_col)), lambda depth: judged(lines, depth)))
    return docs.where(F.col(text_col).isNotNull()).select(*keys, F.explode(all_).alias("x")).select(*keys, "x.*")
