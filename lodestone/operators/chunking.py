"""Texts to chunks: rules over lines, folded inside Spark expressions.

A rule turns the lines of a text into the numbers of the lines that end a chunk. It is a
fold over an array, so it runs in the JVM beside the scan, without a shuffle; the rule of
brackets is a helper that an Arrow UDF calls for each text, which remembers what short
lines hold, as most of them repeat. Texts are independent of each other. What works on
neighbouring chunks afterwards partitions by document.

Cases: null and blank texts give no chunks; a line longer than a chunk is a chunk of its
own unless ``char_windows`` cuts it.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, let, scan

# fixed values: limits of the strategies (lines, characters, least characters, depth)
LIMITS = {"line": (50, 3000, 0, 0), "bracket": (50, 3000, 200, 3), "xml": (50, 3000, 200, 10), "markdown": (100, 3000, 0, 0)}
# fixed values: languages that are cut by brackets or tags
BRACKET_LANGUAGES = ["javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust"]
TAG_LANGUAGES = ["xml", "html"]
#: Lines before a full chunk's end that are searched for a better place in Markdown.
LOOK_BACK = 20


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _fold(lines: Column, marks: Callable[[Column], dict[str, Column]], start: dict[str, Column], step: Callable[[Column, Column, Column], tuple[Column, dict[str, Column]]]) -> Column:
    """Ends of chunks. ``step`` gets state, line and the number of the last line, and
    gives the ends to add (an array) and the next state."""
    begin = F.struct(F.array().cast("array<int>").alias("ends"), *[c.alias(k) for k, c in start.items()])

    def fold(held: Column, last: Column) -> Column:
        items = F.transform(held, lambda x, i: F.struct(i.alias("i"), F.length(x).alias("len"), *[c.alias(k) for k, c in marks(x).items()]))

        def merge(s: Column, x: Column) -> Column:
            ends, state = step(s, x, last)
            # the ends so far are copied once a chunk, not once a line
            kept = let(ends, lambda e: F.when(F.size(e) > 0, F.concat(s["ends"], e)).otherwise(s["ends"]))
            return F.struct(kept.alias("ends"), *[c.alias(k) for k, c in state.items()])

        return F.array_distinct(F.concat(F.aggregate(items, begin, merge)["ends"], F.array(last)))

    # lines are split once a text, and counted once
    return let(lines, lambda held: let(F.size(held) - 1, lambda last: fold(held, last)))


def _one(test: Column, end: Column) -> Column:
    return F.when(test, F.array(end.cast("int"))).otherwise(F.array().cast("array<int>"))


def line_ends(text: Column, most_lines: int = 50, most_chars: int = 3000) -> Column:
    """Full chunks end at their last blank or comment line or statement end."""
    good = lambda x: {"good": (F.trim(x) == "") | F.trim(x).rlike(r"^(//|#|/\*|\*)") | F.trim(x).rlike(r"[;}]$")}
    zero = F.lit(0)

    def step(s: Column, x: Column, last: Column):  # noqa: ANN202
        n, chars = s["n"] + 1, s["chars"] + x["len"] + 1
        after = F.when(x["good"], 0).when(s["after"] >= 0, s["after"] + 1).otherwise(-1)
        tail = F.when(x["good"], 0).otherwise(s["tail"] + x["len"] + 1)
        full = (n >= most_lines) | (chars - 1 >= most_chars) | (x["i"] == last)
        back = F.greatest(after, zero)
        kept = F.when(after >= 0, tail).otherwise(0)
        state = {"n": F.when(full, back).otherwise(n), "chars": F.when(full, kept).otherwise(chars), "after": F.when(full, -1).otherwise(after), "tail": F.when(full, kept).otherwise(tail)}
        return _one(full, x["i"] - back), state

    return _fold(lines_of(text), good, {"n": zero, "chars": zero, "after": F.lit(-1), "tail": zero}, step)


BRACKETS, TAGS = (r"[{(\[]", r"[})\]]"), (r"<[A-Za-z][^<>/]*>|<[A-Za-z][^<>]*[^/<>]>", r"</[A-Za-z][^<>]*>")
SIGNS = dict(zip(BRACKETS, ("{([", "})]")))
#: Lines up to so many characters are remembered by a worker, and how many of them.
SHORT_LINE, REMEMBERED = 200, 1 << 15
_pattern = functools.lru_cache(functools.partial(re.compile, flags=re.ASCII))


class Remembered(dict):
    """What a helper says of lines, by line, short ones remembered."""

    def __init__(self, helper: Callable) -> None:
        self.helper = helper

    def __missing__(self, line: str):  # noqa: ANN204
        said = self.helper(line)
        if len(line) <= SHORT_LINE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[line] = said
        return said


def _times(line: str, pattern: str) -> int:
    """How often a pattern stands in a line; most lines have no tag, and single signs need
    no pattern."""
    if pattern in SIGNS:
        return sum(map(line.count, SIGNS[pattern]))
    return len(_pattern(pattern).findall(line)) if pattern not in TAGS or "<" in line else 0


def _net(line: str, pairs: tuple[tuple[str, str], ...]) -> tuple[int, ...] | None:
    """By how much a line opens more of each pair than it closes, none if by nothing."""
    held = tuple(_times(line, a) - _times(line, b) for a, b in pairs)
    return held if any(held) else None


@functools.lru_cache(16)
def _nets(pairs: tuple[tuple[str, str], ...]) -> Remembered:
    return Remembered(lambda line: _net(line, pairs))


def text_balanced_ends(text: str, pairs: tuple[tuple[str, str], ...], least_lines: int, least_chars: int, most_chars: int = 3000, most_lines: int = 50, imbalance: int = 3) -> list[int]:
    """``balanced_ends`` of one text."""
    lines, none = text.split("\n"), (0,) * len(pairs)
    out, n, chars, depth, even, far = [], 0, -1, none, True, False
    for i, net in enumerate(map(_nets(pairs).__getitem__, lines)):
        n += 1
        chars += len(lines[i]) + 1
        if net:
            depth = tuple(map(operator.add, depth, net))
            even = depth == none
            far = max(depth) > imbalance or min(depth) < -imbalance
        if (even and chars >= least_chars and n >= least_lines) or far or chars >= most_chars or n >= most_lines:
            out.append(i)
            n, chars, depth, even, far = 0, -1, none, True, False
    if not out or out[-1] != len(lines) - 1:
        out.append(len(lines) - 1)
    return out


def balanced_ends(text: Column, pairs: list[tuple[str, str]], least_lines: int, least_chars: int, most_chars: int = 3000, most_lines: int = 50, imbalance: int = 3) -> Column:
    """A chunk ends where all kinds of brackets are balanced, once it is large enough, and
    anyway where it is full or too far out of balance; depths start anew behind it."""
    limits = (tuple(pairs), least_lines, least_chars, most_chars, most_lines, imbalance)

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else text_balanced_ends(t, *limits) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return found(text)


#: Pairs, least lines and least characters of the chunks of code in brackets.
BRACKET_RULE = ((BRACKETS, TAGS), 5, 200)


def text_bracket_ends(text: str) -> list[int]:
    return text_balanced_ends(text, *BRACKET_RULE)


def bracket_ends(text: Column) -> Column:
    return balanced_ends(text, *BRACKET_RULE)


# fixed values: elements of HTML that have no end, and those whose text holds no tags
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = ["script", "style"]
#: In a line: comments that end in it, the end and the begin of longer ones, tags, and tags
#: that go on in the next line.
MARKUP = r"(<!--.*?-->|-->|<!--|</[A-Za-z][^<>]*>|<[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*/?>|<[A-Za-z][^<>]*$|^[^<>]*/?>)"
NAME = r"^</?([A-Za-z][\w:.-]*)"
TAG_STATE = "struct<names:array<string>,inside:string>"


def tag_state() -> Column:
    """No open element. ``inside`` is a comment (``!``), a tag that goes on (``<``) or the
    name of an element whose text holds no tags."""
    return F.struct(F.array().cast("array<string>").alias("names"), F.lit("").alias("inside")).cast(TAG_STATE)


def tag_marks(line: Column) -> Column:
    """What the tags of a line do, in their order: ``does`` and the element's name."""
    found = F.regexp_extract_all(line, F.lit(MARKUP), F.lit(1))

    def mark(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, NAME, 1))
        does = (
            F.when(x.startswith("<!--"), F.when(x.endswith("-->"), "none").otherwise("note")).when(x == "-->", "note ends").when(x.startswith("</"), "close")
            .when(x.startswith("<"), F.when(~x.endswith(">"), "begin").when(x.endswith("/>"), "none").otherwise("open")).otherwise(F.when(x.endswith("/>"), "end empty").otherwise("end"))
        )
        return F.struct(does.alias("does"), name.alias("name"))

    return F.filter(F.transform(found, mark), lambda m: (m["does"] != "none") & ~((m["does"] == "open") & m["name"].isin(VOID)))


def after_tag(s: Column, m: Column) -> Column:
    """The elements open behind a tag. An end closes the innermost element of its name and
    what was left open in it; an end without a begin does nothing."""
    names, inside, does, name = s["names"], s["inside"], m["does"], m["name"]
    put = lambda n, i: F.struct(n.alias("names"), i.alias("inside")).cast(TAG_STATE)
    less = F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))
    at = F.size(names) - F.array_position(F.reverse(names), name).cast("int")
    closed = F.when(F.array_contains(names, name), F.slice(names, F.lit(1), F.greatest(at, F.lit(0)))).otherwise(names)
    held = (
        F.when(inside == "!", F.when(does == "note ends", put(names, F.lit(""))).otherwise(s))
        # a tag that began on an earlier line: its element is open unless the tag ends it
        .when(inside == "<", F.when(does == "end", put(F.when(F.element_at(names, -1).isin(VOID), less).otherwise(names), F.when(F.element_at(names, -1).isin(RAW), F.element_at(names, -1)).otherwise(""))).when(does == "end empty", put(less, F.lit(""))).otherwise(s))
        .when(inside != "", F.when((does == "close") & (name == inside), put(closed, F.lit(""))).otherwise(s))
    )
    return held.when(does == "note", put(names, F.lit("!"))).when(does == "open", put(F.concat(names, F.array(name)), F.when(name.isin(RAW), name).otherwise(""))).when(does == "begin", put(F.concat(names, F.array(name)), F.lit("<"))).when(does == "close", put(closed, F.lit(""))).otherwise(s)


def tag_depths(text: Column) -> Column:
    """How many elements are open behind each line."""
    return scan(lines_of(text), tag_state(), lambda s, x: F.aggregate(tag_marks(x), s, after_tag), lambda s: F.size(s["names"]), "int")


def xml_ends(text: Column, least_lines: int = 3, least_chars: int = 200, most_chars: int = 3000, most_lines: int = 50, most_depth: int = 10) -> Column:
    """A chunk ends where every element that began in it has ended, once it is large enough,
    and anyway where it is full or too deep; elements count anew behind it."""
    marks = lambda x: {"tags": tag_marks(x)}

    def step(s: Column, x: Column, last: Column):  # noqa: ANN202
        n, chars = s["n"] + 1, s["chars"] + x["len"] + 1
        tags = F.aggregate(x["tags"], s["tags"], after_tag)
        depth = F.size(tags["names"])
        cut = ((depth == 0) & (n >= least_lines) & (chars - 1 >= least_chars)) | (chars - 1 >= most_chars) | (n >= most_lines) | (depth > most_depth) | (x["i"] == last)
        # a comment or a script goes on behind a cut
        anew = F.struct(F.array().cast("array<string>").alias("names"), F.when(tags["inside"] == "<", "").otherwise(tags["inside"]).alias("inside")).cast(TAG_STATE)
        return _one(cut, x["i"]), {"n": F.when(cut, 0).otherwise(n), "chars": F.when(cut, 0).otherwise(chars), "tags": F.when(cut, anew).otherwise(tags)}

    return _fold(lines_of(text), marks, {"n": F.lit(0), "chars": F.lit(0), "tags": tag_state()}, step)


def markdown_ends(text: Column, most_lines: int = 100, most_chars: int = 3000) -> Column:
    """Chunks begin at headings outside fences; full ones end at a blank line or a rule
    among the last lines, else where they are full."""
    marks = lambda x: {"fence": F.trim(x).startswith("```"), "head": F.trim(x).rlike("^#{1,6} "), "gap": F.trim(x).rlike(r"^(-{3,}|\*{3,})?$")}
    zero, no = F.lit(0), F.lit(False)

    def step(s: Column, x: Column, last: Column):  # noqa: ANN202
        code = s["code"] != x["fence"]
        head = x["head"] & ~code & (s["n"] > 0)
        n, chars = F.when(head, 1).otherwise(s["n"] + 1), F.when(head, x["len"] + 1).otherwise(s["chars"] + x["len"] + 1)
        gap = x["gap"] & ~code
        after = F.when(gap, 0).when(head | (s["after"] < 0), -1).otherwise(s["after"] + 1)
        tail = F.when(gap, 0).otherwise(F.when(head, 0).otherwise(s["tail"]) + x["len"] + 1)
        full = (n > most_lines) | (chars - 1 > most_chars)
        near = (after >= 0) & (after < LOOK_BACK)
        back = F.when(near, after).otherwise(0)
        state = {
            "n": F.when(full, back).otherwise(n), "chars": F.when(full, F.when(near, tail).otherwise(0)).otherwise(chars), "after": F.when(full, -1).otherwise(after), "tail": F.when(full, 0).otherwise(tail), "code": code,
        }
        return F.concat(_one(head, x["i"] - 1), _one(full, x["i"] - back)), state

    return _fold(lines_of(text), marks, {"n": zero, "chars": zero, "after": F.lit(-1), "tail": zero, "code": no}, step)


def fixed_ends(text: Column, size: int) -> Column:
    """Every ``size`` lines."""
    n = F.size(lines_of(text))
    return F.transform(F.sequence(F.lit(1), F.ceil(n / size).cast("int")), lambda k: F.least(k * size, n) - 1)


STRATEGIES = {"line": line_ends, "bracket": bracket_ends, "xml": xml_ends, "markdown": markdown_ends}


def strategy_for(language: Column) -> Column:
    return F.when(language == "markdown", "markdown").when(language.isin(TAG_LANGUAGES), "xml").when(language.isin(BRACKET_LANGUAGES), "bracket").otherwise("line")


def chunks(docs: DataFrame, ends: Column, text_col: str = "text", keys: tuple = ("doc_id",)) -> DataFrame:
    """One row per chunk: ``keys, chunk, start_line, end_line`` (from 1) and ``content``."""
    # texts of chunks are cut before they are dealt out, so that no row holds all lines
    def parts(lines: Column, at: Column) -> Column:
        begins = F.transform(at, lambda e, i: F.struct(F.coalesce(F.get(at, i - 1) + 1, F.lit(0)).alias("b"), e.alias("e")))
        return F.transform(begins, lambda s: F.struct((s["b"] + 1).alias("start_line"), (s["e"] + 1).alias("end_line"), F.array_join(F.slice(lines, s["b"] + 1, s["e"] - s["b"] + 1), "\n").alias("content")))

    # lines and ends are worked out once a text, however many chunks it has; ends come first,
    # as a helper's are not to be had within an expression over lines
    all_ = let(ends, lambda at: let(lines_of(F.col(text_col)), lambda lines: parts(lines, at)))
    cut = docs.where(F.col(text_col).isNotNull()).select(*keys, F.posexplode(all_).alias("chunk", "c"))
    return cut.select(*keys, "chunk", "c.*").where(F.trim(F.translate("content", "\n\t\r", "   ")) != "")


def text_chunks(text: str, ends: list[int]) -> Iterator[tuple[int, int, int, str]]:
    """``chunks`` of one text that end behind the lines ``ends``."""
    lines, begin = text.split("\n"), 0
    for chunk, end in enumerate(ends):
        content = "\n".join(lines[begin : end + 1])
        if content.strip(" \n\t\r"):
            yield chunk, begin + 1, end + 1, content
        begin = end + 1


def chunk_by_language(docs: DataFrame, language_col: str, text_col: str = "text", keys: tuple = ("doc_id",)) -> DataFrame:
    kind = strategy_for(F.col(language_col))
    out = None
    for name, rule in STRATEGIES.items():
        part = chunks(docs.where(kind == name), rule(F.col(text_col)), text_col, keys).withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def char_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of characters, for texts without line ends."""
    begins = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(begins, lambda b: F.substring(text, b + 1, F.lit(size)))


def _joined(rows: DataFrame, keys: tuple, group: str) -> DataFrame:
    """Chunks with the same group become one, in order, joined by a line end."""
    part = F.sort_array(F.collect_list(F.struct("chunk", "start_line", "end_line", "content")))
    out = rows.groupBy(*keys, group).agg(part.alias("p"))
    return out.select(*keys, F.col("p")[0]["chunk"].alias("chunk"), F.array_min("p.start_line").alias("start_line"), F.array_max("p.end_line").alias("end_line"), F.array_join("p.content", "\n").alias("content"))


def filter_small(rows: DataFrame, least: int = 100, keys: tuple = ("doc_id",)) -> DataFrame:
    """Small chunks without a space join the chunk before them (else the one behind) if the
    one behind is of normal size, and go otherwise."""
    order = Window.partitionBy(*keys).orderBy("chunk")
    normal = (F.length("content") >= min(least, 12)) | F.col("content").contains(" ")
    marked = rows.withColumn("_ok", normal).withColumn("_next_ok", F.coalesce(F.lead("_ok").over(order), F.lit(False))).withColumn("_next", F.lead("chunk").over(order))
    before = F.last(F.when(F.col("_ok"), F.col("chunk")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.when(F.col("_ok"), F.col("chunk")).when(F.col("_next_ok"), F.coalesce(before, F.col("_next")))
    return _joined(marked.withColumn("_group", group).where("_group is not null"), keys, "_group")


def rebalance_last(rows: DataFrame, least: int = 200, keys: tuple = ("doc_id",)) -> DataFrame:
    """A last chunk that is too small joins the one before it."""
    order = Window.partitionBy(*keys).orderBy("chunk")
    lonely = F.lead("chunk").over(order).isNull() & (F.length("content") < least)
    group = F.when(lonely, F.coalesce(F.lag("chunk").over(order), F.col("chunk"))).otherwise(F.col("chunk"))
    return _joined(rows.withColumn("_group", group), keys, "_group")


def with_overlap(rows: DataFrame, lines: int = 3, keys: tuple = ("doc_id",)) -> DataFrame:
    """Adds ``overlap``: the last lines of the chunk before."""
    before = lines_of(F.lag("content").over(Window.partitionBy(*keys).orderBy("chunk")))
    return rows.withColumn("overlap", F.array_join(F.slice(before, F.greatest(F.size(before) - lines + 1, F.lit(1)), F.lit(lines)), "\n"))


def merge_neighbours(rows: DataFrame, score: Callable[[Column, Column], Column] | None = None, least: float = 0.75, most_chars: int = 3000, most_gap: int = 50, keys: tuple = ("doc_id",), words: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks whose texts are alike enough join the one before them while both fit into
    ``most_chars`` and stand at most ``most_gap`` lines apart. A document's chunks come
    together, which its text bounds.

    With ``words`` (sets of strings, of which two texts apart by line ends have the union)
    texts are as alike as their sets by the Jaccard measure, equal ones wholly; a set is made
    once a chunk, however many neighbours meet it."""
    item = F.struct("chunk", "start_line", "end_line", "content")
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_c"))
    plain = "struct<chunk:int,start_line:int,end_line:int,content:string>"
    kind = plain[:-1] + ",words:array<string>>"
    fields = lambda x: [x[c].alias(c) for c in ("chunk", "start_line", "end_line", "content")]
    known = lambda x: F.struct(*fields(x), (words(x["content"]) if words else F.array().cast("array<string>")).alias("words")).cast(kind)
    alike = (lambda a, b: F.when(a["content"] == b["content"], 1.0).otherwise(jaccard(a["words"], b["words"]))) if words else (lambda a, b: score(a["content"], b["content"]))
    state = lambda done, top: F.struct(done.cast(f"array<{plain}>").alias("done"), top.cast(kind).alias("top"))
    ended = lambda s: F.concat(s["done"], F.array(F.struct(*fields(s["top"])).cast(plain)))

    def step(s: Column, x: Column) -> Column:
        top = s["top"]
        near = (x["start_line"] - top["end_line"] <= most_gap) & (F.length(top["content"]) + F.length(x["content"]) <= most_chars)
        both = F.struct(top["chunk"].alias("chunk"), top["start_line"].alias("start_line"), F.greatest(top["end_line"], x["end_line"]).alias("end_line"), F.concat(top["content"], F.lit("\n\n"), x["content"]).alias("content"), F.array_union(top["words"], x["words"]).alias("words"))
        return F.when(near & (alike(top, x) >= least), state(s["done"], both)).otherwise(state(ended(s), x))

    def joined(chunks: Column) -> Column:
        rest = F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0)))
        return F.aggregate(rest, state(F.array(), F.element_at(chunks, 1)), step, ended)

    return held.select(*keys, F.explode(let(F.transform("_c", known), joined)).alias("c")).select(*keys, "c.*")


def pair_small(rows: DataFrame, least: int = 100, keys: tuple = ("doc_id",)) -> DataFrame:
    """A small chunk joins the one behind it, which then joins nothing else: of a run of
    small ones every second begins a pair. The last chunk begins none."""
    order = Window.partitionBy(*keys).orderBy("chunk")
    n = F.row_number().over(order)
    marked = rows.withColumn("_n", n).withColumn("_small", (F.length("content") < least) & F.lead("chunk").over(order).isNotNull())
    since = F.coalesce(F.max(F.when(~F.col("_small"), F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    marked = marked.withColumn("_first", F.col("_small") & ((F.col("_n") - since) % 2 == 1))
    group = F.when(F.coalesce(F.lag("_first").over(order), F.lit(False)), F.lag("chunk").over(order)).otherwise(F.col("chunk"))
    return _joined(marked.withColumn("_group", group), keys, "_group")


def merge_contents(first: Column, second: Column, first_line: Column, second_line: Column) -> Column:
    """Two texts as one; lines that both have (by their line numbers) are taken once."""
    a = lines_of(first)
    common = first_line + F.size(a) - second_line
    left = F.slice(a, F.lit(1), F.greatest(F.size(a) - common, F.lit(0)))
    return F.when(common <= 0, F.concat_ws("\n", first, second)).otherwise(F.array_join(F.concat(left, lines_of(second)), "\n"))


def same_chunks(rows: DataFrame, hash_of: Column, keys: tuple = ("doc_id",)) -> DataFrame:
    """``chunk_a, chunk_b`` of one file that have the same hash, the same lines or the same
    text: equal joins, one after another."""
    held = rows.select(*keys, "chunk", hash_of.alias("_h"), F.struct("start_line", "end_line").alias("_l"), F.md5("content").alias("_t"))
    out = None
    for mark in ("_h", "_l", "_t"):
        a, b = held.select(*keys, mark, F.col("chunk").alias("chunk_a")), held.select(*keys, mark, F.col("chunk").alias("chunk_b"))
        part = a.join(b, [*keys, mark]).where("chunk_a < chunk_b").select(*keys, "chunk_a", "chunk_b")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def structural_similarity(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Of a chunk and a later one (type, complexity, size, start_line, end_line), 0 to 1."""
    share = lambda x: F.when(F.greatest(a(x), b(x)) > 0, 1 - F.abs(a(x) - b(x)) / F.greatest(a(x), b(x))).otherwise(0.0)
    apart = b("start_line") - a("end_line")
    # fixed values: weights and the greatest distance in lines
    near = F.when((apart >= 0) & (apart <= 50), 0.3 * (1 - apart / 50)).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(a("type") == b("type"), 0.3).otherwise(0.0) + 0.2 * share("complexity") + 0.2 * share("size") + near)


def _alike(a: dict, b: dict) -> float:
    """``structural_similarity`` of two chunks; -1 where a measure is missing."""
    if any(x[c] is None for x in (a, b) for c in ("complexity", "size", "start_line", "end_line")):
        return -1.0
    share = lambda x: 1 - abs(a[x] - b[x]) / max(a[x], b[x]) if max(a[x], b[x]) > 0 else 0.0
    apart = b["start_line"] - a["end_line"]
    near = 0.3 * (1 - apart / 50) if 0 <= apart <= 50 else 0.0
    return min(1.0, (0.3 if a["type"] is not None and a["type"] == b["type"] else 0.0) + 0.2 * share("complexity") + 0.2 * share("size") + near)


def joined_chunks(chunks: list[dict], least: float) -> list[tuple[int, int]]:
    """``chunk, into`` of a document's chunks, in their order. Lines count in steps of 64: a
    chunk meets those that end in the step where it begins or in the one before."""
    kept: dict[int, list[dict]] = {}
    out = []
    for b in sorted(chunks, key=lambda x: x["chunk"]):
        near = kept.get((b["start_line"] or 0) // 64, ())
        into = next((a["chunk"] for a in near if a["chunk"] < b["chunk"] and _alike(a, b) >= least - 1e-9), None)
        if into is None:
            step = (b["end_line"] or 0) // 64
            for s in (step, step + 1):
                kept.setdefault(s, []).append(b)
        out.append((b["chunk"], b["chunk"] if into is None else into))
    return out


def structural_groups(rows: DataFrame, least: float = 0.8, keys: tuple = ("doc_id",)) -> DataFrame:
    """``keys, chunk, into``: every chunk joins the first chunk of its document that is not
    merged itself and that it is alike enough. Alike ones stand within 33 lines, so a chunk
    meets few however long a document is, and the measures of a document's chunks (not
    their texts) are decided in one pass, without rounds. Chunks of no document (a null
    key) join nothing."""
    item = F.struct("chunk", "start_line", "end_line", "type", F.col("complexity").cast("double").alias("complexity"), F.col("size").cast("long").alias("size"))

    @F.arrow_udf("array<struct<chunk:int,into:int>>")
    def decided(docs: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("chunk", pa.int32()), ("into", pa.int32())]))
        return pa.array([[{"chunk": c, "into": i} for c, i in joined_chunks(d, least)] for d in docs.to_pylist()], kind)

    own = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    held = rows.where(own).groupBy(*keys).agg(F.collect_list(item).alias("_c"))
    found = held.select(*keys, F.explode(decided("_c")).alias("c")).select(*keys, "c.*")
    return found.unionByName(rows.where(~own).select(*keys, "chunk", F.col("chunk").alias("into")))


#: Types that may join a generic chunk.
MIXABLE = ("function", "class", "import")


def boundary_groups(rows: DataFrame, most_chars: int = 1000, most_complexity: float = 50.0, keys: tuple = ("doc_id",)) -> DataFrame:
    """``keys, chunk, into``: neighbours join while both fit, their types go together, the
    first is no function or class, and their complexity stays low. One fold over a
    document's chunks (their measures, not their texts)."""
    item = F.struct("chunk", "type", F.length("content").alias("size"), F.col("complexity").cast("double").alias("complexity"))
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_c"))
    state = "struct<into:int,type:string,size:int,complexity:double,out:array<struct<chunk:int,into:int>>>"
    none = F.struct(F.lit(-1).alias("into"), F.lit("").alias("type"), F.lit(0).alias("size"), F.lit(0.0).alias("complexity"), F.array().cast("array<struct<chunk:int,into:int>>").alias("out")).cast(state)

    def step(s: Column, x: Column) -> Column:
        mixed = (s["type"].isin(*MIXABLE) & (x["type"] == "generic")) | (x["type"].isin(*MIXABLE) & (s["type"] == "generic"))
        joins = (s["into"] >= 0) & (s["size"] + x["size"] <= most_chars) & ((s["type"] == x["type"]) | mixed) & ~s["type"].isin("function", "class") & (s["complexity"] + x["complexity"] <= most_complexity)
        into = F.when(joins, s["into"]).otherwise(x["chunk"])
        return F.struct(
            into.alias("into"), F.when(joins, s["type"]).otherwise(x["type"]).alias("type"), F.when(joins, s["size"] + x["size"] + 1).otherwise(x["size"]).alias("size"),
            F.when(joins, s["complexity"] + x["complexity"]).otherwise(x["complexity"]).alias("complexity"), F.concat(s["out"], F.array(F.struct(x["chunk"].alias("chunk"), into.alias("into")))).alias("out"),
        ).cast(state)

    return held.select(*keys, F.explode(F.aggregate("_c", none, step)["out"]).alias("c")).select(*keys, "c.*")


def join_groups(rows: DataFrame, groups: DataFrame, keys: tuple = ("doc_id",)) -> DataFrame:
    """Chunks merged as ``into`` of ``structural_groups`` or ``boundary_groups`` says."""
    return _joined(rows.join(groups, [*keys, "chunk"]), keys, "into")


def overlap_strategy(alike: Column, fits: Column, shared_nodes: Column, gap: Column, boundary: Column) -> Column:
    """Which overlap two neighbours get: by how alike their lines are, whether the sizes fit,
    whether they share nodes of code, and how well one may cut between them."""
    return F.when((alike > 0.8) | ~fits, "smart-dedup").when(shared_nodes | (gap <= 1) & (boundary > 0.6), "node-aware").when(boundary > 0.3, "ast-boundary").otherwise("hybrid")


def definition_ends(text: Column) -> Column:
    """Chunks that begin where a definition begins; a text without one is a single chunk."""
    lines = lines_of(text)
    at = F.filter(F.transform(lines, lambda x, i: F.when((i > 0) & x.rlike(STARTS), i - 1)), lambda i: i.isNotNull())
    return F.array_distinct(F.concat(at, F.array(F.size(lines) - 1)))


def dedup(rows: DataFrame, hash_of: Column, keys: tuple = ("doc_id",)) -> DataFrame:
    """The first chunk of each content hash within a document."""
    rank = F.row_number().over(Window.partitionBy(*keys, "_h").orderBy("chunk"))
    return rows.withColumn("_h", hash_of).withColumn("_r", rank).where("_r = 1").drop("_h", "_r")


def similar_neighbours(rows: DataFrame, keys: tuple = ("doc_id",)) -> DataFrame:
    """Pairs of adjacent or overlapping chunks of a document, by a join on its key."""
    a, b = (rows.select(*keys, F.col("chunk").alias(f"chunk_{x}"), F.col("start_line").alias(f"s_{x}"), F.col("end_line").alias(f"e_{x}")) for x in "ab")
    return a.join(b, [*keys]).where("chunk_a < chunk_b and (s_b = e_a + 1 or (s_b <= e_a and s_a <= e_b))").select(*keys, "chunk_a", "chunk_b")


# fixed values: what starts or ends a block
STARTS, CLOSERS = r"^\s*(function|class|def|interface|struct|fn|func|public|private|async)\b", r"[}\])];?\s*$"


def boundary_score(line: Column, following: Column) -> Column:
    """How well a text may be cut behind a line, 0 to 1."""
    return F.least(F.lit(1.0), F.when(F.trim(line) == "", 0.3).otherwise(0.0) + F.when(line.rlike(CLOSERS), 0.4).otherwise(0.0) + F.when(following.rlike(STARTS), 0.4).otherwise(0.0) + F.when(F.trim(line).rlike(r"^(//|#|\*)"), 0.2).otherwise(0.0))


def overlap_quality(text: Column) -> Column:
    lines = lines_of(text)
    full = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) > 2))
    yes = lambda test, w: F.when(test, w).otherwise(0.0)
    return F.least(F.lit(1.0), yes(text.rlike(STARTS), 0.3) + yes(F.trim(text).rlike(CLOSERS), 0.2) + yes(F.trim(text).rlike(r"^(//|#|/\*)"), 0.1) + yes(F.size(lines) < 10, 0.2) + yes(full * 2 > F.size(lines), 0.2))


def embedded(pages: DataFrame, html_col: str = "html", keys: tuple = ("page_id",)) -> DataFrame:
    """Script and style blocks of HTML pages: ``kind, block, attributes, language, code``."""
    out = None
    for kind, default in (("script", "javascript"), ("style", "css")):
        found = F.regexp_extract_all(F.col(html_col), F.lit(rf"(?is)(<{kind}\b[^>]*>.*?</{kind}\s*>)"), F.lit(1))
        part = pages.select(*keys, F.lit(kind).alias("kind"), F.posexplode(found).alias("block", "b"))
        attributes = F.regexp_extract("b", rf"(?is)^<{kind}\b([^>]*)>", 1)
        named = F.regexp_extract(attributes, r"(?i)(?:type|lang)\s*=\s*[\"']?(?:text/|application/)?([\w-]+)", 1)
        part = part.select(*keys, "kind", "block", F.trim(attributes).alias("attributes"), F.when(named == "", default).otherwise(F.lower(named)).alias("language"), F.regexp_extract("b", r"(?is)^<[^>]*>(.*)</[^>]*>$", 1).alias("code"))
        out = part if out is None else out.unionByName(part)
    return out
