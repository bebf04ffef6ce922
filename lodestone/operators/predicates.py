"""Filters given as plain dictionaries, as columns that Catalyst can push down."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = {"gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v}


def condition(df: DataFrame, key: str, value: object) -> Column:
    """Equality, membership (list), range ({gte, lte, gt, lt}) or a ready Column. An
    array column matches a list if any element does. Dots reach into struct fields."""
    if isinstance(value, Column):
        return value
    col = F.col(key)
    is_array = key in df.columns and dict(df.dtypes)[key].startswith("array")
    if isinstance(value, dict):
        return reduce(lambda a, b: a & b, [RANGE[op](col, v) for op, v in value.items()])
    if isinstance(value, (list, tuple, set)):
        values = list(value)
        if not values:
            return F.lit(True)
        return F.arrays_overlap(col, F.array(*map(F.lit, values))) if is_array else col.isin(values)
    return F.array_contains(col, value) if is_array else col == value


def matches(df: DataFrame, conditions: dict) -> Column:
    """All conditions; none of them means no filter."""
    return reduce(lambda a, b: a & b, [condition(df, k, v) for k, v in conditions.items()], F.lit(True))


def boolean(must: list[Column] = (), should: list[Column] = (), must_not: list[Column] = ()) -> Column:
    """All of ``must``, one of ``should``, none of ``must_not``; each may be missing."""
    out = reduce(lambda a, b: a & b, must, F.lit(True))
    if should:
        out = out & reduce(lambda a, b: a | b, should)
    return reduce(lambda a, b: a & ~b, must_not, out)


def glob_regex(pattern: str) -> str:
    """** any path, * and ? within a path part; anchored. A leading **/ also matches none."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] in "*?":
            out, i = out + ("[^/]*" if pattern[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(ignored, regex) of every gitignore line; the last that matches decides."""
    rules = []
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        ignored, line = not line.startswith("!"), line.removeprefix("!")
        whole = line.endswith("/")
        body = line.strip("/")
        start = "" if line.startswith("/") or "/" in body else "**/"
        rules.append((ignored, glob_regex(start + body)[:-1] + ("/.*$" if whole else "(?:/.*)?$")))
    return rules


def is_ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    out = F.lit(False)
    for ignored, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(ignored)).otherwise(out)
    return out


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page under a total order, which the caller must give."""
    return df.orderBy(*order).offset(offset).limit(limit)


# fixed values: words that a read-only query must not hold
FORBIDDEN = ["drop", "delete", "insert", "update", "create", "alter", "truncate"]


def check_query(text: str, longest: int = 10_000) -> list[str]:
    """What speaks against running a raw query; empty if nothing does."""
    found = []
    if not text.strip() or len(text) > longest:
        found.append("length")
    if text.count("(") != text.count(")"):
        found.append("parentheses")
    return found + [w for w in FORBIDDEN if re.search(rf"\b{w}\b", text, re.IGNORECASE)]
