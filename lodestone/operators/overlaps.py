"""What a chunk hands on to the next one as overlap, by several strategies.

From the end of a chunk backwards lines are taken by size, by syntax (all of them up to a
part of the chunk) or by meaning (good places to cut and signatures); a chunk whose
neighbour is across a gap hands on the gap if definitions begin in it that no earlier
overlap had; and at lines where definitions begin or end. The strategy is chosen for each
pair of neighbours, the hybrid takes the best of three by its quality. A file's chunks meet
its text, and so its definitions, in one row, which the text bounds; helpers that Arrow
UDFs call work on one file after another and remember what they found out about short
lines. Chunks that a rule makes of a text (``text_overlaps``) need no shuffle at all.

Cases: the last chunk of a document hands on nothing; a chunk of one line hands that line
on; null languages have the common weights; repeated rows count apart; files that are not
there have no definitions; an overlap that one of the last three boundaries of a document
had already gives way to one by size.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boundaries import _FUNCTION_CLOSED, _java, line_is, line_scores
from .chunking import Remembered, text_chunks
from .structure import text_spans

# fixed values: characters, lines and part of the chunk that an overlap may have, and the
# score of a good place to cut
MOST_CHARS, LEAST_LINES, MOST_PART, MOST_GAP, GOOD = 200, 1, 0.3, 50, 0.6
_REMARK, _CLOSING = map(_java, (r"^(?://|/\*)", r"^[}\])];?$"))


_trimmed = Remembered(lambda line: line.strip(" "))
#: Lines that are neither blank nor a comment; whether lines begin a definition and a comment.
_says = Remembered(lambda line: line.strip(" ") != "" and not _REMARK.search(line.strip(" ")))
_begins = Remembered(lambda line: (line_is(line, "function") or line_is(line, "class"), _REMARK.search(line.strip(" ")) is not None))


def _is_good(line: str, language: str | None) -> bool:
    closed = _FUNCTION_CLOSED.search(line.translate({9: " ", 13: " "}).strip(" "))
    return closed is not None and line_scores(language)[line] > GOOD


@functools.lru_cache(64)
def _good(language: str | None) -> Remembered:
    """Good places to cut, by line."""
    return Remembered(lambda line: _is_good(line, language))


@functools.lru_cache(64)
def _means(language: str | None) -> Remembered:
    """Good places and signatures, by line."""
    return Remembered(lambda line: _is_good(line, language) or line_is(line, "function"))


def lines_quality(lines: list[str]) -> float:
    """0 to 1: begins with a definition or a comment, ends with a closing sign, is short and
    mostly says something."""
    if not lines:
        return 0.0
    defines, remarks = _begins[lines[0]]
    # fixed values: shares
    score = (0.3 if defines else 0.0) + (0.2 if _CLOSING.search(lines[-1].strip(" ")) else 0.0) + (0.1 if remarks else 0.0)
    return min(1.0, score + (0.2 if len(lines) < 10 else 0.0) + (0.2 if 2 * sum(map(_says.__getitem__, lines)) > len(lines) else 0.0))


def lines_by_size(content: str) -> list[str]:
    held, size, total = [], 0, len(content)
    for x in reversed(content.split("\n")):
        # every line counts with its end
        if size + len(x) + 1 > MOST_CHARS:
            break
        held.append(x)
        size += len(x) + 1
        if total and size / total > MOST_PART:
            break
    return held[::-1]


def lines_by_syntax(content: str) -> list[str]:
    held, chars, total = [], -1, len(content)
    for x in reversed(content.split("\n")):
        if chars >= MOST_CHARS:
            break
        held.append(x)
        chars += len(x) + 1
        if total and chars / total > MOST_PART:
            break
    return held[::-1]


def lines_by_meaning(content: str, language: str | None) -> list[str]:
    held, chars, total, means = [], -1, len(content), _means(language)
    for x in reversed(content.split("\n")):
        # what is held is full, or no line fits any more
        if chars >= MOST_CHARS or (held and (chars + 1) / total > MOST_PART):
            break
        if len(held) < LEAST_LINES or ((chars + 1 + len(x)) / total <= MOST_PART and means[x]):
            held.append(x)
            chars += len(x) + 1
    return held[::-1]


def lines_at_definitions(content: str, language: str | None, start_line: int | None, marks: list[int]) -> list[str]:
    """Good lines among those where a definition begins or ends (``marks``, line numbers)."""
    lines, held, chars = content.split("\n"), [], 0
    at = [m - start_line for m in marks if 0 <= m - start_line < len(lines)] if start_line is not None else []
    for i in sorted(set(at), reverse=True):
        fits = chars < MOST_CHARS and (not content or chars / len(content) <= MOST_PART)
        if fits and (len(held) < LEAST_LINES or _good(language)[lines[i]]):
            held.append(lines[i])
            chars += len(lines[i]) + 1
    return held[::-1]


def best_lines(content: str, language: str | None) -> list[str]:
    """The best of three by quality, the first of equal ones."""
    return max(lines_by_meaning(content, language), lines_by_syntax(content), lines_by_size(content), key=lines_quality)


def _by_row(helper: Callable, kind: str, arrow: pa.DataType) -> Callable[..., Column]:
    """A column of what ``helper`` says of each row, null where the first column is."""

    @F.arrow_udf(kind)
    def said(*columns: pa.Array) -> pa.Array:
        return pa.array([None if row[0] is None else helper(*row) for row in zip(*[c.to_pylist() for c in columns])], arrow)

    return said


def by_size(content: Column) -> Column:
    return _by_row(lines_by_size, "array<string>", pa.list_(pa.string()))(content)


def by_syntax(content: Column) -> Column:
    return _by_row(lines_by_syntax, "array<string>", pa.list_(pa.string()))(content)


def by_meaning(content: Column, language: Column) -> Column:
    return _by_row(lines_by_meaning, "array<string>", pa.list_(pa.string()))(content, language)


def hybrid(content: Column, language: Column) -> Column:
    """The best of three by quality, the first of equal ones."""
    return _by_row(best_lines, "array<string>", pa.list_(pa.string()))(content, language)


def good_place(line: Column, language: Column) -> Column:
    """Whether a line scores above ``GOOD``. Without neighbours only the end of a function
    can: all other factors that it may have come to less, so most lines cost one pattern."""
    return _by_row(_is_good, "boolean", pa.bool_())(line, language)


def near_chunks(text: str | None, starts: list[int | None], ends: list[int | None]) -> list[dict]:
    """Of every chunk of a text, in order: where the innermost definition around its last
    line ends, the lines near its end (and up to the next chunk) where definitions begin or
    end, and the lines up to the next chunk, if a definition begins in them."""
    spans = sorted({(row[2], -row[3]) for row in text_spans(text)}) if text is not None else []
    lines = text.split("\n") if text is not None else []
    owner: list[int | None] = [None] * (len(lines) + 2)
    # the inner one of two comes later
    for begin, end in spans:
        owner[begin : 1 - end] = [-end] * (1 - end - begin)
    begins = sorted({begin for begin, _ in spans})
    marks = sorted({*begins, *(-end for _, end in spans)})
    out = []
    for start, end, following in zip(starts, ends, [*starts[1:], None]):
        if not spans or start is None or end is None:
            out.append({"owner_end": None, "marks": [], "gap": None})
            continue
        after = end if following is None else following
        high = min(max(after, end), end + MOST_GAP)
        near = marks[bisect.bisect_left(marks, max(start, end - MOST_GAP)) : bisect.bisect_right(marks, high)]
        i = bisect.bisect_right(begins, end)
        gap = i < len(begins) and begins[i] < after and begins[i] <= high
        out.append({"owner_end": owner[end] if 0 < end < len(owner) else None, "marks": near, "gap": lines[end : min(after - 1, end + MOST_GAP)] if gap else None})
    return out


def _strategy(content: str | None, following: str, alike: float | None, start: tuple, near: dict, language: str | None) -> str:
    """Which overlap two neighbours get, as ``chunking.overlap_strategy`` says."""
    end_line, next_line = start
    if (alike is not None and alike > 0.8) or max(len(content or ""), len(following)) * MOST_PART < LEAST_LINES * 50:
        return "smart-dedup"
    known = end_line is not None and next_line is not None
    boundary = 0.0 if content is None else line_scores(language)[content.rpartition("\n")[2]]
    shared = near["owner_end"] is not None and next_line is not None and near["owner_end"] >= next_line
    if shared or (known and (next_line > end_line + 1 or boundary > 0.6)):
        return "node-aware"
    return "ast-boundary" if boundary > 0.3 else "hybrid"


def chunk_overlaps(text: str | None, language: str | None, chunks: list[tuple[int, int | None, int | None, str | None]]) -> list[tuple]:
    """``chunk, strategy, overlap, quality`` of the chunks of one text (``chunk, start_line,
    end_line, content``, in order) that have one behind them."""
    out, recent = [], []
    near = near_chunks(text, [c[1] for c in chunks], [c[2] for c in chunks])
    sets = [None if c[3] is None else set(map(_trimmed.__getitem__, c[3].split("\n"))) - {""} for c in chunks]
    for i, (chunk, start, end, content) in enumerate(chunks[:-1]):
        _, next_line, _, following = chunks[i + 1]
        if following is None:
            continue
        a, b = sets[i], sets[i + 1]
        both = len(a & b) if a and b else 0
        alike = None if a is None else both / (len(a) + len(b) - both) if a and b else 0.0
        name = _strategy(content, following, alike, (end, next_line), near[i], language)
        lines = (near[i]["gap"] if name == "node-aware" else None) or None
        if lines is None and content is not None:
            if name == "hybrid":
                lines = best_lines(content, language)
            else:
                lines = (name == "ast-boundary" and lines_at_definitions(content, language, start, near[i]["marks"])) or lines_by_meaning(content, language)
        overlap = None if lines is None else "\n".join(lines)
        seen = overlap is not None and overlap in recent
        # the last three boundaries count by what they would have handed on
        recent = [*recent[-2:], overlap]
        # what was handed on a moment ago is not handed on again
        if name == "smart-dedup" and seen:
            lines = lines_by_size(content)
            overlap = "\n".join(lines)
        out.append((chunk, name, overlap, lines_quality(lines)))
    return out


OVERLAP = "array<struct<chunk:int,strategy:string,overlap:string,quality:double>>"


def _held(rows: list[list[tuple]]) -> pa.Array:
    """Rows of ``OVERLAP``."""
    ends, flat = [0], []
    for r in rows:
        flat += r
        ends.append(len(flat))
    columns = list(zip(*flat)) if flat else [()] * 4
    kinds = {"chunk": pa.int32(), "strategy": pa.string(), "overlap": pa.string(), "quality": pa.float64()}
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds)))


def overlaps(rows: DataFrame, files: DataFrame, text_col: str = "text", language_col: str = "language", keys: tuple = ("doc_id",)) -> DataFrame:
    """``keys, chunk, strategy, overlap, quality`` of every chunk (``chunk, start_line,
    end_line, content``) of ``files`` that has one behind it."""

    @F.arrow_udf(OVERLAP)
    def found(texts: pa.Array, languages: pa.Array, starts: pa.Array, ends: pa.Array, contents: pa.Array) -> pa.Array:
        columns = [c.to_pylist() for c in (texts, languages, starts, ends, contents)]
        return _held([chunk_overlaps(t, k, list(zip(range(len(s)), s, e, c))) for t, k, s, e, c in zip(*columns)])

    # one row a file, so that nothing but texts and chunks is dealt out
    item = F.struct("chunk", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "content")
    whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_c")).where(F.size("_c") > 1)
    whole = whole.join(files.select(*keys, F.col(text_col).alias("_text"), F.col(language_col).alias("_language")), list(keys), "left")
    whole = whole.withColumn("_o", found("_text", "_language", "_c.start_line", "_c.end_line", "_c.content"))
    out = F.transform("_o", lambda x: F.struct(F.get(F.col("_c.chunk"), x["chunk"]).alias("chunk"), *[x[c].alias(c) for c in ("strategy", "overlap", "quality")]))
    return whole.select(*keys, F.explode(out).alias("o")).select(*keys, "o.*")


def text_overlaps(files: DataFrame, ends: Callable[[str], list[int]], text_col: str = "text", language_col: str = "language", keys: tuple = ("doc_id",)) -> DataFrame:
    """``overlaps`` of the chunks that ``ends`` (the numbers of the lines that end one) makes
    of every file. Text, chunks and definitions stand in one row, so nothing is shuffled."""

    @F.arrow_udf(OVERLAP)
    def found(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return _held([chunk_overlaps(t, k, list(text_chunks(t, ends(t)))) if t is not None else [] for t, k in zip(texts.to_pylist(), languages.to_pylist())])

    # a test of the text beside the helper would have it made twice where an expression makes it
    rows = files.select(*keys, F.explode(found(F.col(text_col), F.col(language_col))).alias("o"))
    return rows.select(*keys, "o.*")
