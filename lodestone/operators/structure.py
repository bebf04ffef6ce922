"""Definitions of code as a tree of spans, and chunks made of them.

No parser is at hand. A stack machine runs over the lines of a text instead: a line that
begins a definition pushes it, and it is popped where its curly bracket closes or, for a
definition that ends in a colon, where the indentation falls back to its own. Brackets in
strings and comments do not count; block comments and triple quotes may span lines. The
machine is a helper that an Arrow UDF calls for each text, so it runs beside the scan,
without a shuffle; the stack is as deep as the nesting, a closed definition is written
once, and a worker remembers what it found out about short lines, as most of them repeat.

Cases: null texts give no rows, texts without a definition (or without one of the right
size) are one chunk, blank ones none; a definition without a body is one line; one that
never closes ends with the text's last line that is not blank; text behind the end of a
block comment on its line is not read; of several definitions on a line the first counts.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import MODIFIERS
from ..functions.text import let
from .chunking import Remembered, lines_of
from .spans import NEAR, innermost

#: Kinds of definitions and the pattern, with a group for the name, of a line that begins one.
DEFINITIONS = {
    "class": rf"^\s*{MODIFIERS}class\s+([A-Za-z_$][\w$]*)",
    "interface": rf"^\s*{MODIFIERS}(?:interface|trait|protocol)\s+([A-Za-z_$][\w$]*)",
    "struct": rf"^\s*{MODIFIERS}(?:struct|enum|union|record|impl(?:<[^>]*>)?)\s+([A-Za-z_$][\w$]*)|^\s*type\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b",
    "namespace": rf"^\s*{MODIFIERS}(?:namespace|module|mod)\s+([A-Za-z_$][\w$.:]*)",
    "function": rf"^\s*{MODIFIERS}(?:function\s*\*?|def|fn|func(?:\s*\([^)]*\))?)\s+([A-Za-z_$][\w$]*)|^\s*{MODIFIERS}(?:let\s+|var\s+)?([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::\s*[\w<>\[\]., |]+)?\s*=>|\w+\s*=>)",
    # a name and brackets before the curly one, perhaps with types before and behind, or
    # alone behind a type, with the curly one on a later line
    "method": rf"^\s*{MODIFIERS}(?:[A-Za-z_][\w<>\[\],.?*&:]*\s+)?[*&~#]?([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\((?![^)]*\bfunction\b)[^;{{}}]*\)\s*(?:(?::|->)\s*[\w<>\[\]., |?&]+|const|noexcept|override|throws\s+[\w, .]+)?\s*\{{(?:\s*|.*\}}\s*)$|^\s*{MODIFIERS}(?:(?!(?:return|await|yield|throw|new|else|not|in)\b)[A-Za-z_][\w<>\[\],.?*&:]*\s+)[*&~]?([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*$",
}
#: What a line of each kind holds somewhere, so that most patterns are not looked for.
HOLDS = {
    "class": ("class",), "interface": ("interface", "trait", "protocol"), "struct": ("struct", "enum", "union", "record", "impl", "interface"), "namespace": ("namespace", "module", "mod"),
    "function": ("function", "def", "fn", "func", "=>"), "method": ("(",),
}
#: Words before a bracket that begin no method.
NO_METHODS = "if for while switch catch return else do try with synchronized foreach using lock match unless elif except function new".split()
#: What a line needs to begin a definition.
MAYBE = r"\b(?:class|interface|trait|protocol|struct|enum|union|record|impl|type|namespace|module|mod|function|def|fn|func)\b|=>|\)[^;]*(?:$|\{)"
#: Strings and comments within a line, whichever begins first; marks of longer ones.
WHOLE_TRIPLE = r'"""(?:[^"]|"(?!""))*"""|' + r"'''(?:[^']|'(?!''))*'''"
ASIDE = r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|/\*.*?\*/|//.*$|^\s*#.*$"
TRIPLE = r"\"\"\"|'''"
#: Levels below the outermost that become chunks; characters of a chunk.
MOST_LEVEL, LEAST_CHARS, MOST_CHARS = 5, 50, 2000

SPAN = {"kind": "string", "name": "string", "start_line": "int", "end_line": "int", "level": "int", "parent_line": "int"}
USE = {"line": "int", "does": "string", "name": "string"}
#: Bodies of a definition: none so far, between brackets, by indentation.
WAITING, BRACKETS, INDENTED = 0, 1, 2

def _compiled(pattern: str) -> re.Pattern:
    """A pattern with the meaning that it has in Spark's expressions: classes of ASCII, a
    dot that is no line end of any kind, an end before a last carriage return."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out, i = out + pattern[i : i + 2], i + 2
            continue
        inside = c == "[" or (inside and c != "]")
        out += c if inside or c not in ".$" else r"[^\n\r\x85\u2028\u2029]" if c == "." else r"(?=[\r\x85\u2028\u2029]?\Z)"
        i += 1
    return re.compile(out, re.ASCII)


_MAYBE, _ASIDE, _TRIPLE, _WHOLE_TRIPLE = map(_compiled, (MAYBE, ASIDE, TRIPLE, WHOLE_TRIPLE))
_TRIPLE_ON, _NOTE, _SIGNS, _COLON, _ENDS, _COLON_LATER = map(_compiled, (f"(?:{TRIPLE}).*$", r"/\*.*$", r"[\"'`/#]", r"^\s*(?:async\s+)?(?:def|class)\b[^{]*:", r";\s*$", r"^\s*\).*:\s*$"))
_KINDS = {kind: _compiled(p) for kind, p in DEFINITIONS.items()}
_SPACE = " \t\n\x0b\f\r"


def _found(code: str) -> tuple[str, str] | None:
    """Kind and name of the first kind of definition that a line begins."""
    if _MAYBE.search(code):
        for kind, pattern in _KINDS.items():
            m = any(map(code.__contains__, HOLDS[kind])) and pattern.search(code)
            name = m and next((g for g in m.groups() if g), None)
            if name and name not in NO_METHODS:
                return kind, name
    return None


class Line(NamedTuple):
    """What the machine has to know of a line."""

    blank: bool
    indent: int
    found: tuple[str, str] | None
    opens: bool
    colon: bool  #: a body by indentation follows
    ends: bool
    colon_later: bool
    closed: int  #: closing brackets before any other
    now: int  #: depth behind the rest of the brackets, against that before them
    low: int  #: the smallest depth behind one of them
    note: bool
    note_ends: bool
    triple: bool
    triple_ends: bool
    idle: bool  #: neither blank nor anything that may open or close a definition by itself


def _line(raw: str) -> Line:
    triples = _TRIPLE.search(raw) is not None
    plain = _WHOLE_TRIPLE.sub("", raw) if triples else raw
    aside = _ASIDE.sub("", _TRIPLE_ON.sub("", plain)) if _SIGNS.search(raw) else raw
    note = "/*" in aside
    c = _NOTE.sub("", aside) if note else aside
    signs = [x for x in c if x in "{}"]
    closed = next((i for i, x in enumerate(signs) if x == "{"), len(signs))
    now, low = 0, 1000
    for x in signs[closed:]:
        now += 1 if x == "{" else -1
        low = min(low, now)
    opens = "{" in signs
    odd = lambda x: triples and len(_TRIPLE.findall(x)) % 2 == 1
    blank, found, triple = not c.strip(" \t\r"), _found(c), odd(plain)
    return Line(
        blank, len(raw) - len(raw.lstrip(_SPACE)), found, opens, ":" in c and bool(_COLON.search(c)), ";" in c and bool(_ENDS.search(c)), not opens and ":" in c and bool(_COLON_LATER.search(c)), closed, now, low,
        note, "*/" in raw, triple, odd(raw), not (blank or found or signs or note or triple),
    )


_known_line = Remembered(_line)


class Open(NamedTuple):
    """A definition that has not ended."""

    kind: str
    name: str
    start: int
    depth: int
    body: int
    indent: int
    level: int
    parent: int


def _end(e: Open, x: Line, i: int, last: int, depth: int, lowest: int) -> int:
    """The last line of an open definition that this line closes, -1 if it stays open, -2 if
    it was a call after all, as its body does not come."""
    waits = e.body == WAITING
    if e.body == INDENTED and x.indent <= e.indent:
        return last
    if waits and not x.opens and (x.ends or x.found is not None or depth < e.depth):
        return -2 if e.kind == "method" else e.start
    if (e.body == BRACKETS and x.closed > 0 and e.depth >= depth) or ((e.body == BRACKETS or (waits and x.opens)) and e.depth >= lowest):
        return i
    return -1


def text_spans(text: str) -> list[tuple]:
    """All definitions of a text by line, with the columns of ``SPAN``."""
    depth = quoted = last = 0
    # no definition waits for its body, and the indentation up to which a line closes one
    calm, edge = True, -1
    stack: list[Open] = []
    out: list[tuple] = []
    put = lambda e, end: out.append((e.kind, e.name, e.start + 1, end + 1, e.level, e.parent + 1 if e.parent >= 0 else None))
    for i, x in enumerate(map(_known_line.__getitem__, text.split("\n"))):
        if calm and not quoted and x.idle and x.indent > edge:
            last = i
            continue
        silent = quoted != 0 or x.blank
        if quoted:
            quoted = 0 if (x.note_ends if quoted == 1 else x.triple_ends) else quoted
        else:
            quoted = 2 if x.triple else 1 if x.note else 0
        if silent:
            continue
        # what the line closes, then what it opens
        depth -= x.closed
        lowest = depth + x.low
        if not calm or x.indent <= edge or x.closed or lowest <= depth:
            kept = []
            for e in stack:
                end = _end(e, x, i, last, depth, lowest)
                if end >= 0:
                    put(e, end)
                elif end == -1:
                    kept.append(e._replace(body=BRACKETS if x.opens else INDENTED) if e.body == WAITING and (x.opens or x.colon_later) else e)
            stack = kept
        if x.found:
            new = Open(*x.found, i, depth, BRACKETS if x.opens else INDENTED if x.colon else WAITING, x.indent, len(stack), stack[-1].start if stack else -1)
            if x.opens and depth >= lowest:
                put(new, i)
            else:
                stack.append(new)
        depth, last = depth + x.now, i
        calm, edge = True, -1
        for e in stack:
            calm, edge = calm and e.body != WAITING, max(edge, e.indent) if e.body == INDENTED else edge
    for e in stack:
        if e.body != WAITING or e.kind != "method":
            put(e, e.start if e.body == WAITING else last)
    return sorted(out, key=lambda row: row[2])


def _by_text(helper: Callable[[str], list[tuple]], fields: dict[str, str]) -> Callable[[Column], Column]:
    """A column of arrays of ``fields``: the rows that ``helper`` finds in each text."""
    types = {"string": pa.string(), "int": pa.int32()}

    @F.arrow_udf(f"array<struct<{','.join(f'{c}:{t}' for c, t in fields.items())}>>")
    def found(texts: pa.Array) -> pa.Array:
        ends, rows = [0], []
        for text in texts.to_pylist():
            rows += helper(text) if text is not None else []
            ends.append(len(rows))
        columns = list(zip(*rows)) if rows else [()] * len(fields)
        held = pa.StructArray.from_arrays([pa.array(c, types[t]) for c, t in zip(columns, fields.values())], list(fields))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)

    return found


def spans(text: Column) -> Column:
    """All definitions of a text by line: ``kind, name, start_line, end_line`` (from 1),
    ``level`` (0: in no other) and ``parent_line``, where the innermost around it begins."""
    return _by_text(text_spans, SPAN)(text)


def definitions(files: DataFrame, text_col: str = "text", keys: tuple = ("doc_id",)) -> DataFrame:
    """A row for every definition: ``keys`` and the columns of ``spans``."""
    # null texts have none; a test of the text would have it made twice where an expression makes it
    return files.select(*keys, F.explode(spans(F.col(text_col))).alias("d")).select(*keys, "d.*")


def structure_chunks(files: DataFrame, text_col: str = "text", keys: tuple = ("doc_id",), most_level: int = MOST_LEVEL, least_chars: int = LEAST_CHARS, most_chars: int = MOST_CHARS) -> DataFrame:
    """Definitions of up to ``most_level`` levels whose size is right, outer and inner ones,
    each with its text; a text that has none is one chunk of kind ``generic``. A definition
    that is too large is represented by the ones inside it."""
    text = F.col(text_col)

    def chosen(lines: Column, found: Column) -> Column:
        cut = lambda d: F.array_join(F.slice(lines, d["start_line"], d["end_line"] - d["start_line"] + 1), "\n")
        texts = F.transform(F.filter(found, lambda d: d["level"] <= most_level), lambda d: F.struct(*[d[c].alias(c) for c in ("kind", "name", "start_line", "end_line", "level", "parent_line")], cut(d).alias("content")))
        right = F.filter(texts, lambda d: F.length(d["content"]).between(least_chars, most_chars))
        whole = F.array(F.struct(F.lit("generic").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("start_line"), F.size(lines).alias("end_line"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("parent_line"), text.alias("content")))
        return let(right, lambda r: F.when(F.size(r) > 0, r).otherwise(whole))

    both = let(lines_of(text), lambda lines: chosen(lines, F.col("_spans")))
    rows = files.where(text.isNotNull() & (F.trim(F.translate(text, "\n\t\r", "   ")) != "")).withColumn("_spans", spans(text))
    return rows.select(*keys, F.posexplode(both).alias("chunk", "c")).select(*keys, "chunk", "c.*")


#: Names before a bracket, and members of the object itself that are not called.
CALLED, MEMBER = r"(?<![\w$.])((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*)\s*\(", r"\b(?:this|self)\.([A-Za-z_$][\w$]*)\b(?!\s*\()"
_CALLED, _MEMBER = map(_compiled, (CALLED, MEMBER))
NO_CALLS = frozenset(NO_METHODS) - {"new"}


def _uses(raw: str) -> list[tuple[str, str]]:
    """What a line does, and the names that it does it to."""
    code = _ASIDE.sub("", raw) if _SIGNS.search(raw) else raw
    own = (_found(code) or (None, ""))[1] if "(" in code else ""
    called = [name.rpartition(".")[2] for name in _CALLED.findall(code)] if "(" in code else []
    return [("CALLS", n) for n in called if n not in NO_CALLS and n != own] + [("ACCESSES", n) for n in _MEMBER.findall(code)]


_known_uses = Remembered(_uses)


def text_uses(text: str) -> list[tuple]:
    """All uses of a text by line, with the columns of ``USE``."""
    return [(i, *use) for i, raw in enumerate(text.split("\n"), 1) for use in _known_uses[raw]]


def uses(files: DataFrame, text_col: str = "text", keys: tuple = ("doc_id",)) -> DataFrame:
    """``keys, line, does (CALLS, ACCESSES), name``: functions that lines call, by the last
    part of their name, and members that they touch; strings and line comments left out. A
    line that begins a definition does not call it."""
    rows = files.select(*keys, F.explode(_by_text(text_uses, USE)(F.col(text_col))).alias("u"))
    return rows.select(*keys, "u.*")


def text_owned_uses(text: str) -> list[tuple]:
    """All uses of a text with the innermost definition around the line of each."""
    found = text_uses(text)
    around: list[tuple] = [(None,) * 4] * (text.count("\n") + 2)
    # a definition that begins later lies within, or goes on behind, an earlier one
    for kind, name, start, end, *_ in text_spans(text) if found else ():
        around[start : end + 1] = [(start, end, name, kind)] * (end + 1 - start)
    return [use + around[use[0]] for use in found]


def text_ended_uses(text: str) -> list[tuple]:
    """All uses of a text with the first two definitions that begin within ``NEAR`` lines."""
    found = text_uses(text)
    near = [(row[2], f"{row[0]}:{row[1]}") for row in text_spans(text)] if found else []
    starts, out = [at for at, _ in near], []
    for use in found:
        i = bisect.bisect_left(starts, use[0] - NEAR) + 1
        two = i < len(near) and starts[i] <= use[0] + NEAR
        out.append((*use, near[i - 1][1] if two else None, near[i][1] if two else None))
    return out


OWNED = USE | {"owner_line": "int", "owner_end": "int", "owner_name": "string", "owner_kind": "string"}
ENDED = USE | {"from_id": "string", "to_id": "string"}


def owned_uses(files: DataFrame, text_col: str = "text", keys: tuple = ("doc_id",)) -> DataFrame:
    """``uses`` with ``owner_line, owner_end, owner_name, owner_kind`` of the innermost
    definition around each (nulls outside of all), as ``spans.innermost`` would join it.
    Both stand in one text, so nothing is shuffled."""
    rows = files.select(*keys, F.explode(_by_text(text_owned_uses, OWNED)(F.col(text_col))).alias("u"))
    return rows.select(*keys, "u.*")


def ended_uses(files: DataFrame, text_col: str = "text", keys: tuple = ("doc_id",)) -> DataFrame:
    """``uses`` with ``from_id, to_id`` (``kind:name``): the first two definitions that
    begin at most ``NEAR`` lines away, as ``spans.endpoints`` would join them."""
    rows = files.select(*keys, F.explode(_by_text(text_ended_uses, ENDED)(F.col(text_col))).alias("u"))
    return rows.select(*keys, "u.*")


def usage_edges(files: DataFrame, text_col: str = "text", keys: tuple = ("doc_id",)) -> DataFrame:
    """``keys, src_line, src, type, dst_key.., dst_line, dst``: CALLS from the innermost
    definition around a call to the functions and methods of that name (those of the file if
    it has any, else those of all files), and ACCESSES from it to members (``dst_line`` is
    where the class around it begins)."""
    spans = definitions(files, text_col, keys)
    owned = owned_uses(files, text_col, keys).where("owner_line is not null")
    source = [*keys, F.col("owner_line").alias("src_line"), F.col("owner_name").alias("src")]
    targets = spans.where("kind in ('function', 'method')").select(F.struct(*keys).alias("at"), F.col("start_line").alias("dst_line"), F.col("name").alias("dst"))
    calls = owned.where("does = 'CALLS'").select(*source, F.col("name").alias("dst"), F.struct(*keys).alias("own")).distinct()
    here = calls.join(targets.withColumnRenamed("at", "own"), ["own", "dst"])
    # names that the file does not define are looked for in all files
    rest = calls.join(here.select("own", "dst").distinct(), ["own", "dst"], "left_anti").join(targets, "dst")
    columns = [*keys, "src_line", "src", F.lit("CALLS").alias("type"), "dst_file", "dst_line", "dst"]
    called = here.withColumn("dst_file", F.col("own")).select(*columns).unionByName(rest.withColumn("dst_file", F.col("at")).select(*columns))
    classes = spans.where("kind in ('class', 'struct', 'interface')")
    touched = innermost(owned.where("does = 'ACCESSES'"), classes, keys, "class_").where("class_line is not null")
    members = touched.select(*source, F.lit("ACCESSES").alias("type"), F.struct(*keys).alias("dst_file"), F.col("class_line").alias("dst_line"), F.col("name").alias("dst")).distinct()
    return called.where(~(F.col("dst_file").eqNullSafe(F.struct(*keys)) & (F.col("src_line") == F.col("dst_line")))).distinct().unionByName(members)
