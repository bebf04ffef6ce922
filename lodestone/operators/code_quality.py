"""Measures of code texts as columns: balance of symbols, indentation, quality of a chunk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

# fixed values: strings and comments, which symbols do not count in, in this order
ASIDE = [r"(?s)/\*.*?\*/", r"//[^\n]*", r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"]
PAIRS = {"round": ("(", ")"), "curly": ("{", "}"), "square": ("[", "]")}
# fixed values: marks of unfinished or broken code, names of functions and classes
ERRORS = r"(?i)\b(error|exception|fixme|todo|hack|bug)\b"
FUNCTION_NAME, CLASS_NAME = r"(?:function\s+(\w+)|(\w+)\s*=\s*(?:function|\([^)]*\)\s*=>))", r"class\s+(\w+)"


def _count(text: Column, symbol: str) -> Column:
    return F.length(text) - F.length(F.translate(text, symbol, ""))


def plain_code(text: Column) -> Column:
    for pattern in ASIDE:
        text = F.regexp_replace(text, pattern, " ")
    return text


def symbol_balance(text: Column) -> Column:
    """Open less closed brackets of each kind outside strings and comments, whether quotes
    of templates come in pairs, and whether a text may be split behind this one."""
    def counted(code: Column) -> Column:
        kinds = {name: _count(code, a) - _count(code, b) for name, (a, b) in PAIRS.items()}
        template = _count(code, "`") % 2
        safe = (template == 0) & (kinds["round"] == 0) & (kinds["curly"] == 0) & (kinds["square"] == 0)
        return F.struct(*[v.alias(k) for k, v in kinds.items()], template.alias("template"), safe.alias("safe"))

    return let(plain_code(text), counted)


def indentation(text: Column) -> Column:
    """``style`` (spaces, tabs, mixed, none) and the mean number of leading blanks of lines
    that are indented."""
    begins = lambda lines: F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^([ \t]+)\S", 1)), lambda x: x != "")

    def judge(b: Column) -> Column:
        tabs, spaces = F.exists(b, lambda x: F.contains(x, F.lit("\t"))), F.exists(b, lambda x: F.contains(x, F.lit(" ")))
        style = F.when(tabs & spaces, "mixed").when(tabs, "tabs").when(spaces, "spaces").otherwise("none")
        total = F.aggregate(b, F.lit(0), lambda a, x: a + F.length(x))
        return F.struct(style.alias("style"), F.when(F.size(b) > 0, total / F.size(b)).otherwise(0.0).alias("size"))

    return let(begins(F.split(text, "\n")), judge)


def brace_depth(text: Column) -> Column:
    """Greatest depth of curly brackets."""
    signs = F.transform(F.filter(F.split(text, ""), lambda c: c.isin("{", "}")), lambda c: F.when(c == "{", 1).otherwise(-1))
    deeper = lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most"))
    return F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), deeper)["most"]


def chunk_quality(text: Column) -> Column:
    """0 to 1: balanced brackets, comments, names in the usual case, few levels of curly
    brackets, no marks of unfinished code."""
    lines = F.split(text, "\n")
    balanced = (_count(text, "{") == _count(text, "}")) & (_count(text, "(") == _count(text, ")")) & (_count(text, "[") == _count(text, "]"))
    comments = F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"^(//|/\*|\*)"))) / F.size(lines)
    names = lambda pattern, groups: F.filter(F.flatten(F.transform(lines, lambda x: F.array(*[F.regexp_extract(x, pattern, g) for g in groups]))), lambda n: n != "")
    named = F.forall(names(FUNCTION_NAME, (1, 2)), lambda n: n.rlike("^[a-z][a-zA-Z0-9]*$")) & F.forall(names(CLASS_NAME, (1,)), lambda n: n.rlike("^[A-Z][a-zA-Z0-9]*$"))
    yes = lambda test, w: F.when(test, w).otherwise(0.0)
    # fixed values: weights
    score = yes(balanced, 0.3) + F.least(comments * 0.5, F.lit(0.2)) + yes(named, 0.2) + yes(brace_depth(text) <= 2, 0.1) + yes(~text.rlike(ERRORS), 0.2)
    return F.least(score, F.lit(1.0))
