"""Text measures as Spark columns: keywords, similarity, complexity, quality, intent."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: English stop words, then stop words of code
STOP_WORDS = """the a an and or but in on at to for of with by from up about into through during
before after above below between among is are was were be been being have has had do does did
will would could should may might must can this that these those i you he she it we they what
which who when where why how not no yes all any both each few more most other some such only own
same so than too very just
var let const function return if else for while do switch case break continue try catch finally
throw new class extends import export default async await public private protected static void
int string bool true false null undefined""".split()
# fixed values: shortest keyword by kind of content
LEAST_KEYWORD = {"code": 2, "generic": 2, "document": 3}
THRESHOLDS = {"keyword": 0.6, "levenshtein": 0.85, "semantic": 0.75}


def any_of(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


#: Where a word of ASCII begins or ends; Java's own sign takes letters of all scripts for
#: parts of words, though its classes do not.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


@cache
def portable(pattern: str) -> str:
    """A pattern in Java's spelling with the meaning that it has elsewhere: words and blanks
    (no vertical tab) of ASCII, and no line end but the line feed."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        inside = c == "[" or (inside and c != "]")
        out += {r"\b": EDGE, r"\s": r"\t\n\f\r " if inside else r"[\t\n\f\r ]"}.get(c, c)
        i += len(c)
    return "(?d)" + out


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(portable(pattern)))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def keywords(text: Column, kind: str = "document") -> Column:
    """Distinct lower-case words but stop words, numbers and short ones."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "), r"\s+")
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    # repeats go first, so the pattern meets distinct words alone
    return F.filter(F.array_except(words, stop), lambda w: (F.length(w) >= LEAST_KEYWORD[kind]) & ~w.rlike(r"^\d+$"))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is worked out once a row, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, step, out, kind: str) -> Column:  # noqa: ANN001
    """What ``out`` makes of the state behind each item, of ``kind``. Results are gathered
    by 256, so an item copies no more than those, not all before it."""
    begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("last"))

    def put(s: Column, x: Column) -> Column:
        def add(state: Column) -> Column:
            last = F.concat(s["last"], F.array(out(state).cast(kind)))
            full = F.size(s["last"]) >= 255
            return F.struct(state.alias("state"), F.when(full, F.concat(s["full"], F.array(last))).otherwise(s["full"]).alias("full"), F.when(full, F.array().cast(f"array<{kind}>")).otherwise(last).alias("last"))

        return let(step(s["state"], x), add)

    return let(F.aggregate(items, begin, put), lambda s: F.concat(F.flatten(s["full"]), s["last"]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where either is empty."""
    share = lambda m, n, both: F.when((m == 0) | (n == 0), F.lit(0.0)).otherwise(both / (m + n - both))
    sizes = lambda s: F.struct(F.size(s["a"]).alias("m"), F.size(s["b"]).alias("n"), F.size(F.array_intersect(s["a"], s["b"])).alias("both"))
    # what makes the arrays is worked out once, not wherever they are named
    return let(let(F.struct(a.alias("a"), b.alias("b")), sizes), lambda s: share(s["m"], s["n"], s["both"]))


def keyword_similarity(a: Column, b: Column, kind: str = "document") -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(jaccard(keywords(a, kind), keywords(b, kind)))


def clamp(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def plain(text: Column, compat: bool = False) -> Column:
    """Without comments, squeezed, lower case. With ``compat`` line ends go first, so that
    everything after the first // is a comment."""
    text = F.regexp_replace(text, r"\s+", " ") if compat else text
    text = F.regexp_replace(F.regexp_replace(text, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def levenshtein_similarity(a: Column, b: Column, compat: bool = False) -> Column:
    x, y = plain(a, compat), plain(b, compat)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(clamp(1 - F.levenshtein(x, y) / longest))


def hybrid(levenshtein: Column, semantic: Column, keyword: Column, weights: tuple = (0.4, 0.4, 0.2)) -> Column:
    """Weighted mean; a missing score gives its weight to the others."""
    parts = list(zip((levenshtein, semantic, keyword), weights))
    total = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts])
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * w for c, w in parts]) / total


def generic_complexity(text: Column) -> Column:
    letters = F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    value = 1 + F.log10(F.length(text) + 1) + 2 * F.log10(line_count(text) + 1) + 0.5 * F.log10(letters + 1)
    return F.round(F.greatest(F.lit(1.0), value)).cast("long")


def markdown_complexity(text: Column) -> Column:
    value = (
        F.length(text) * 0.01 + count(text, r"(?m)^#{1,6}\s+") * 2 + count(text, "```") / 2 * 3 + count(text, r"\|") * 0.5
        + count(text, r"(?m)^[-*+]\s+") + F.log10(line_count(text) + 1) * 2
    )
    return F.round(value).cast("long")


def html_complexity(text: Column) -> Column:
    keywords_ = count(text, r"\b(function|class|const|let|var|if|for|while|return|import|export)\b")
    value = 1 + F.log10(F.length(text) + 1) + 2 * F.log10(line_count(text) + 1) + 0.5 * keywords_
    return F.round(F.greatest(F.lit(1.0), value)).cast("long")


def xml_complexity(text: Column) -> Column:
    """Tags, attributes and the greatest depth that whole lines reach."""
    step = F.transform(F.split(text, "\n"), lambda x: F.regexp_count(x, F.lit(r"<[^/][^>]*>")) - F.regexp_count(x, F.lit(r"</[^>]*>")))
    depth = F.aggregate(
        step,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, x: F.struct((s["now"] + x).cast("int").alias("now"), F.greatest(s["most"], s["now"] + x).cast("int").alias("most")),
    )["most"]
    value = count(text, r"</?[^>]+>") * 2 + count(text, r"""\w+\s*=\s*["'][^"']*["']""") + depth * 3 + 2 * F.log10(line_count(text) + 1)
    return F.round(value).cast("long")


def chunk_complexity(text: Column) -> Column:
    value = (
        count(text, r"\b(if|else|while|for|switch|case|try|catch|finally)\b") * 2 + count(text, r"\b(function|method|class|interface)\b") * 3
        + count(text, "[{}]") + count(text, "[()]") * 0.5 + 2 * F.log10(line_count(text) + 1)
    )
    return F.round(value).cast("long")


def estimated_complexity(text: Column) -> Column:
    return (count(text, r"\b(function|class|interface)\b") * 10 + count(text, r"\b(if|else|for|while|switch)\b") * 5 + count(text, r"[{}()\[\]]")).cast("long")


def semantic_line_score(line: Column) -> Column:
    """How much a line of code says: its length, keywords and brackets."""
    # fixed values: keyword groups and what each adds
    groups = {r"\b(function|class|interface|const|let|var)\b": 10, r"\b(if|else|while|for|switch|case)\b": 5, r"\b(import|export|require|from)\b": 8, r"\b(try|catch|finally|throw)\b": 6, r"\b(return|break|continue)\b": 4}
    score = F.length(line).cast("double")
    for pattern, gain in groups.items():
        score = score + F.when(line.rlike(pattern), gain).otherwise(0)
    score = score + count(line, "[{}]") * 3 + count(line, "[()]") * 2 + count(line, r"[\[\]]") * 1.5
    return F.when(F.trim(line) == "", F.lit(1.0)).when(line.rlike(r"^\s*(//|/\*|\*)"), score * 0.3).otherwise(score)


def worth_keeping(text: Column, code: bool, least: float = 0.1) -> Column:
    """Whether a text's quality reaches ``least``; a null text's does not."""
    return F.coalesce(F.round(content_quality(text, code), 6) >= least, F.lit(False))


def content_quality(text: Column, code: bool) -> Column:
    lines = F.split(text, "\n")
    n = F.size(lines)
    capped = lambda pattern, each, most: F.least(count(text, pattern) * each, F.lit(most))
    score = F.least(n / 10, F.lit(0.3))
    if code:
        score = score + capped(r"\b(function|class|def|interface|struct)\b", 0.1, 0.2) + capped(r"\b(if|else|while|for|switch|case|try|catch)\b", 0.05, 0.2) + capped(r"\b(let|const|var|int|string|bool|float|double)\b", 0.03, 0.1)
    else:
        score = score + capped(r"(?m)^#{1,6}\s+", 0.1, 0.2) + capped(r"(?s)```.*?```", 0.15, 0.3) + capped(r"(?m)^[-*+]\s+", 0.05, 0.1)
    blank = F.size(F.filter(lines, lambda x: F.trim(x) == "")) / n
    comment = F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"^(//|#|/\*|\*|<!--)"))) / n
    score = score - F.when(blank > 0.5, 0.2).otherwise(0.0) - F.when(comment > 0.8, 0.3).otherwise(0.0)
    return clamp(score)


def normalized(text: Column) -> Column:
    """What identifies a chunk: without trailing blanks, blank lines, line comments, with
    one kind of quotes and single spaces."""
    # fixed values: the steps in order
    for pattern, by in ((r"(?m)[ \t]+$", ""), (r"\t", "  "), (r"\n\s*\n", "\n"), (r"(?m)//.*$", ""), ("'", '"'), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(normalized(text), 256), 1, 16)


def line_ending(text: Column) -> Column:
    crlf = count(text, "\r\n")
    lf, cr = count(text, "\n") - crlf, count(text, "\r") - crlf
    return F.when((crlf > 0) & (lf == 0) & (cr == 0), "CRLF").when((lf > 0) & (crlf == 0) & (cr == 0), "LF").when((cr > 0) & (crlf == 0) & (lf == 0), "CR").otherwise("mixed")


def structured(text: Column) -> Column:
    return (count(text, r"[{}()\[\]]") / F.length(text) > 0.01) | (count(text, "<[^>]+>") / F.length(text) > 0.005)


# fixed values: generic patterns of code features
FEATURES = {
    "has_imports": r"import\s+|from\s+.*import|require\s*\(|#include|use\s+",
    "has_exports": r"export\s+|module\.exports|__all__\s*=",
    "has_functions": r"function\s+\w+|def\s+\w+|func\s+\w+|fn\s+\w+|=>\s*\{|const\s+\w+\s*=\s*\(",
    "has_classes": r"class\s+\w+|type\s+\w+\s+struct|struct\s+\w+",
}


def max_nesting(text: Column) -> Column:
    """Greatest depth of brackets, where a closing one never goes below 0."""
    marks = F.filter(F.split(text, ""), lambda c: c.isin("{", "(", "[", "}", ")", "]"))
    return F.aggregate(
        marks,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct(
            F.greatest(s["now"] + F.when(c.isin("{", "(", "["), 1).otherwise(-1), F.lit(0)).alias("now"),
            F.greatest(s["most"], s["now"] + F.when(c.isin("{", "(", "["), 1).otherwise(-1)).alias("most"),
        ),
    )["most"]


# fixed values: language by file extension
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "java": "java", "cpp": "cpp", "c": "c", "h": "c", "hpp": "cpp", "cs": "csharp", "rs": "rust",
    "go": "go", "scala": "scala", "kt": "kotlin", "swift": "swift", "php": "php", "rb": "ruby", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "html": "html", "htm": "html", "css": "css",
    "scss": "scss", "sass": "sass", "less": "less", "md": "markdown", "txt": "text", "sql": "sql",
}
# fixed values: group and base complexity of languages
LANGUAGE_GROUPS = {
    "code-heavy": "typescript javascript java python cpp c csharp rust go scala kotlin swift php ruby", "config": "json yaml xml", "markup": "html", "style": "css scss sass less", "documentation": "markdown text", "database": "sql",
}
LANGUAGE_COMPLEXITY = {
    "typescript": 0.8, "java": 0.9, "cpp": 0.85, "rust": 0.85, "scala": 0.8, "csharp": 0.8, "python": 0.5, "javascript": 0.6, "go": 0.6, "kotlin": 0.7, "swift": 0.7, "php": 0.6, "ruby": 0.5, "json": 0.2,
    "yaml": 0.2, "xml": 0.4, "html": 0.4, "css": 0.3, "scss": 0.4, "sass": 0.4, "less": 0.4, "markdown": 0.1, "text": 0.1, "sql": 0.5,
}


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(normal_path(path), "/"), -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(normal_path(path), r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def lookup(values: dict, key: Column, default: object) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def language(path: Column) -> Column:
    return lookup(LANGUAGES, extension(path), "other")


def language_group(lang: Column) -> Column:
    return lookup({x: g for g, names in LANGUAGE_GROUPS.items() for x in names.split()}, lang, "miscellaneous")


def file_complexity(lang: Column, size: Column) -> Column:
    base = lookup(LANGUAGE_COMPLEXITY, lang, 0.5)
    return F.when(size > 200 * 1024, F.least(F.lit(1.0), base + 0.2)).when(size > 100 * 1024, F.least(F.lit(1.0), base + 0.1)).when(size < 10 * 1024, F.greatest(F.lit(0.1), base - 0.1)).otherwise(base)


# fixed values: priority of groups of files, and factors of the time that languages take
GROUP_PRIORITY = {"code-heavy": 80, "config": 90, "style": 60, "markup": 50, "documentation": 30, "database": 70, "miscellaneous": 20}
LANGUAGE_TIME = {"typescript": 1.5, "java": 1.8, "cpp": 1.6, "rust": 1.7, "python": 1.2, "javascript": 1.3, "json": 0.5, "yaml": 0.5, "html": 0.8, "css": 0.7, "markdown": 0.3}


def last_directories(path: Column, depth: int = 3) -> Column:
    """A path's directory, or its last ``depth`` parts where it has more."""
    parts = F.split(directory(path), "/")
    return F.array_join(F.when(F.size(parts) > depth, F.slice(parts, -depth, depth)).otherwise(parts), "/")


# fixed values: terms of the intent rules, Chinese and English
PATH_TERMS = ["目录", "文件夹", "路径", "下", "在", "位于", "path", "directory", "folder"]
PLACE_TERMS = ["in", "在", "位于", "under", "下"]
NAMED_TERMS = ["directory", "folder", "目录", "文件夹"]
SEMANTIC_TERMS = ["相关", "关于", "涉及", "包含", "用于", "功能", "作用", "描述", "说明", "related", "about", "authentication"]
EXTENSION_TERMS = ["扩展名", "extension", "文件类型", "file type", "typescript"]
TIME_TERMS = ["最近", "最新", "昨天", "今天", "上周", "last", "recent", "new"]
NO_NAME_TERMS = ["相关", "关于", "涉及", "包含", "用于", "功能", "作用", "描述", "说明", "related", "about", "for", "find", "search", "files", "authentication", "all"]
# fixed values: words that are no keywords of a file query
QUERY_STOP = """的 了 在 是 我 有 和 就 不 人 都 一 个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 里 就是 还 把 比 从 被 本 吗 呢 些 样 想 开 知道 什么 时候 怎么 为什么 哪里
who what when where why how find search look for get all the a an and or but in on at to for of with by from up about into through during before after above below between among throughout despite towards upon""".split()


def intent_flags(query: Column) -> dict[str, Column]:
    q = F.lower(F.trim(query))
    path = any_of(q, PATH_TERMS) & any_of(q, PLACE_TERMS)
    semantic = any_of(q, SEMANTIC_TERMS) | (any_of(q, ["find", "search"]) & ~q.contains("typescript") & ~q.contains("files"))
    ext = q.rlike(r"\.\w+$") | any_of(q, EXTENSION_TERMS) | (q.contains("files") & ~q.contains("related") & ~q.contains("authentication")) | q.rlike(r"\.[a-zA-Z]+")
    exact = q.rlike(r"^[\w-]+\.\w+$") | ~any_of(q, NO_NAME_TERMS)
    return {"exact": exact, "path": path, "semantic": semantic, "extension": ext, "files": q.contains("files"), "named": any_of(q, NAMED_TERMS), "time": any_of(q, TIME_TERMS)}


def query_keywords(query: Column) -> Column:
    """Keywords of a file query as they stand in it: words without signs and stop words, an
    extension at its end, then all names of more than two letters."""
    q = F.lower(F.trim(query))
    words = F.filter(F.transform(F.split(q, r"\s+"), lambda w: F.regexp_replace(w, r"[^\w\u4e00-\u9fa5]", "")), lambda w: (F.length(w) > 1) & ~w.isin(QUERY_STOP))
    ending = F.regexp_extract_all(q, F.lit(r"(\.\w+)$"), F.lit(1))
    return F.array_distinct(F.concat(words, ending, F.filter(F.regexp_extract_all(q, F.lit(r"([\w-]+)"), F.lit(1)), lambda w: F.length(w) > 2)))


def intent(query: Column) -> tuple[Column, Column]:
    """Kind of a file query and how sure that is: the first rule that holds."""
    f = intent_flags(query)
    two = (f["path"].cast("int") + f["semantic"].cast("int") + f["extension"].cast("int")) >= 2
    rules = [
        (f["exact"], "EXACT_FILENAME", 0.9), (f["extension"] & f["files"] & ~f["path"], "EXTENSION_SEARCH", 0.85), (f["path"] & ~f["semantic"] & f["named"], "PATH_PATTERN", 0.8), (two, "HYBRID_QUERY", 0.75),
        (f["extension"], "EXTENSION_SEARCH", 0.85), (f["path"], "PATH_PATTERN", 0.8), (f["semantic"], "SEMANTIC_DESCRIPTION", 0.85),
    ]
    kind, sure = F, F
    for test, name, confidence in rules:
        kind, sure = kind.when(test, F.lit(name)), sure.when(test, F.lit(confidence))
    return kind.otherwise("HYBRID_QUERY"), sure.otherwise(0.75)


def code_to_text(code: Column) -> Column:
    """Identifiers as words: camel and snake case split, signs out, squeezed."""
    text = F.regexp_replace(code, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[_\W]+", " "), r"\s+", " ")))
