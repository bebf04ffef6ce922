"""Which language a text is written in, and what its lines are, by patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, portable

#: Characters from the start that tell the language.
HEAD = 200
# fixed values: patterns of each language, in the order in which equal scores are decided
PATTERNS = {
    "javascript": [
        r"\b(function|const|let|var)\s+\w+", r"\b=>\s*", r"\bimport\s+.*\bfrom\s+", r"\bexport\s+(default\s+)?\w+", r"\bclass\s+\w+", r"\binterface\s+\w+", r"\btype\s+\w+\s*=", r"\benum\s+\w+", r"\bdeclare\s+",
        r"\bconsole\.(log|error|warn|info)", r"\bdocument\.(getElementById|querySelector)", r"\brequire\s*\(", r"\bwindow\.", r"\basync\s+function", r"\bawait\s+", r"\bPromise\.", r"\btry\s*\{.*\}\s*catch\s*\(",
    ],
    "python": [
        r"\bdef\s+\w+\s*\(", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import", r"\bclass\s+\w+.*:", r"\bif\s+.*:", r"\bfor\s+\w+\s+in\s+.*:", r"\bwhile\s+.*:", r"\btry\s*:", r"\bwith\s+.*as\s+\w+:", r"\bprint\s*\(",
        r"""\bif\s+__name__\s*==\s*["']__main__["']""", r"\bself\.", r"\b__init__\s*\(", r"\blambda\s+", r"\breturn\s+", r"\byield\s+",
    ],
    "java": [
        r"\bpublic\s+class\s+\w+", r"\bprivate\s+\w+\s+\w+", r"\bpublic\s+static\s+void\s+main", r"\bimport\s+java\.", r"\bSystem\.out\.println", r"\bnew\s+\w+\(", r"\b@Override", r"\bthrows\s+\w+", r"\bpackage\s+[\w.]+",
        r"\binterface\s+\w+", r"\bextends\s+\w+", r"\bimplements\s+\w+", r"\bstatic\s+", r"\bfinal\s+", r"\bvoid\s+",
    ],
    "go": [
        r"\bpackage\s+\w+", r"""\bimport\s+["'][\w/]+["']""", r"\bfunc\s+\w+\s*\(", r"\btype\s+\w+\s+struct\s*\{", r"\bfunc\s+\(.*\)\s*\w+\s*\{", r"\bchan\s+\w+", r"\bgo\s+\w+\(", r"\binterface\s*\{", r":=\s*make\s*\(",
        r"\bfmt\.(Print|Scan)", r"\blen\s*\(", r"\bappend\s*\(", r"\bdefer\s+", r"\bselect\s*\{", r"\brange\s+", r"\bgoroutine\s+",
    ],
    "rust": [
        r"\bfn\s+\w+", r"\bstruct\s+\w+", r"\bimpl\s+\w+", r"\buse\s+\w+", r"\blet\s+mut\s+", r"\b->\s", r"&str", r"\bprintln!", r"\bmatch\s+", r"\bOption<\w+>", r"\bResult<\w+,\s*\w+>", r"\bmut\s+", r"\bref\s+", r"\bmove\s+",
        r"\blifetime\s+", r"\btrait\s+\w+", r"\benum\s+\w+", r"\bmod\s+\w+",
    ],
    "cpp": [
        r"#include\s+[<\"]", r"\bint\s+main\s*\(", r"\bstd::\w+", r"\bcout\s*<<", r"\bcin\s*>>", r"\busing\s+namespace\s+std", r"\bclass\s+\w+", r"\btemplate\s*<", r"#define\s+\w+", r"\bnamespace\s+\w+", r"\bvirtual\s+", r"\boverride\s+",
        r"\bpublic\s*:", r"\bprivate\s*:", r"\bprotected\s*:", r"\bfriend\s+",
    ],
    "csharp": [
        r"\busing\s+[\w.]+", r"\bnamespace\s+\w+", r"\bpublic\s+class\s+\w+", r"\bprivate\s+\w+\s+\w+", r"\bpublic\s+static\s+void\s+Main", r"\bConsole\.(WriteLine|ReadLine)", r"\bnew\s+\w+\(", r"\boverride\s+", r"\bvirtual\s+",
        r"\binterface\s+\w+", r"\babstract\s+class", r"\bsealed\s+class", r"\bpartial\s+class", r"\basync\s+", r"\bawait\s+", r"\bvar\s+\w+\s*=", r"\bList<\w+>", r"\bDictionary<\w+,\s*\w+>",
    ],
}
# fixed values: what makes JavaScript TypeScript
TYPED = [
    r"\binterface\s+\w+", r"\btype\s+\w+\s*=", r"\benum\s+\w+", r"\bdeclare\s+", r":\s*\w+\s*(\[\]|&|\|)", r":\s*\w+\s*=\s*\w+", r"\bextends\s+\w+\s*<\w+>", r"\bimplements\s+\w+", r"\breadonly\s+\w+", r"\babstract\s+class",
    r"\bprivate\s+\w+", r"\bprotected\s+\w+", r"\bpublic\s+\w+",
]
MODIFIERS = r"(?:(?:export|default|public|private|protected|internal|static|abstract|final|sealed|partial|async|override|virtual|unsafe|pub|const)\s+)*"
# Rules for the kind of a trimmed line, one after another. An import brings names in by the
# word that it begins with, a comment begins with a sign of one; types and functions begin
# with their word behind any modifiers, or are names with brackets that open a body; an end
# is nothing but closing signs, or the word.
LINE_KINDS = {
    "import": [r"^(?:import|from|use|using|package|include)\s", r"^#\s*(?:include|import)\b", r"^(?:(?:const|let|var)\s.*=\s*)?require\b"],
    "comment": [r"^(?://|/[*]|[*]|#|--|<!--)"],
    "class": [rf"^{MODIFIERS}(?:class|interface|trait|protocol|struct|enum|union|record|impl|namespace|type)\s+\w"],
    "function": [rf"^{MODIFIERS}(?:function|def|fn|func)\b", rf"^{MODIFIERS}(?:(?:let|var)\s+)?\w+\s*[=:]\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]*)?=>", rf"^{MODIFIERS}(?:\w[\w<>\[\].]*\s+)?\w+\s*\([^;]*\)\s*(?::\s*[\w<>\[\]]+\s*)?\{{$"],
    "end": [r"^[}\])]+[;,]?\s*(?://.*)?$", r"^end(?:if|function|\s+\w+)?;?$"],
}


def matches(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns stand in a text."""
    return reduce(lambda a, b: a + b, [text.rlike(portable(p)).cast("int") for p in patterns])


def language_of(text: Column) -> Column:
    """``language, confidence``: the language whose patterns a text's beginning meets most
    (``unknown`` without any) and its share of all that are met."""
    head = F.substring(text, 1, HEAD)

    def judge(h: Column) -> Column:
        typed, script = matches(h, TYPED), matches(h, PATTERNS["javascript"])
        scores = [(F.when(typed > 0, "typescript").otherwise("javascript"), F.when(typed > 0, typed + script).otherwise(script))]
        scores += [(F.lit(name), matches(h, p)) for name, p in PATTERNS.items() if name != "javascript"]
        return F.array(*[F.struct(s.alias("score"), n.alias("name")) for n, s in scores])

    def best(all_: Column) -> Column:
        most, total = F.array_max(F.transform(all_, lambda x: x["score"])), F.aggregate(all_, F.lit(0), lambda a, x: a + x["score"])
        first = F.element_at(F.filter(all_, lambda x: x["score"] == most), 1)["name"]
        return F.struct(F.when(most < 1, "unknown").otherwise(first).alias("language"), F.when(most < 1, 0.0).otherwise(most / total).alias("confidence"))

    return let(let(head, judge), best)


def line_kind(line: Column) -> Column:
    """What a line is: the first kind of ``LINE_KINDS`` that it meets, else ``other``."""
    out = F
    for kind in LINE_KINDS:
        out = out.when(is_kind(line, kind), kind)
    return out.otherwise("other")


def is_kind(line: Column, kind: str) -> Column:
    """Whether a line meets a kind's own rules, whatever comes before it."""
    return F.trim(line).rlike("|".join(LINE_KINDS[kind]))
