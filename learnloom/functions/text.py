"""Text columns: cleaners, intents, labels. All are built-in expressions, so they stay inside generated code.

Patterns use ``(?U)`` where white space, digits and word characters follow Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .emotion import let


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Each run of white space as one space, and none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def swapped(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after another: a later pair sees what an earlier one wrote."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def rewritten(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Pattern replacements, one after another."""
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), pairs, text)


# Swaps of the book cleaner.
BOOK_SWAPS = [("O", "0"), ("．", "."), ("，", ","), ("；", ";"), ("：", ":"), ("l", "I")]
# Patterns of the book cleaner.
BOOK_PATTERNS = [
    (r"\n{3,}", "\n\n"),
    (r"(?mdU)www\.ityinhu\.com\s*$", ""),
    (r"(?dU)(\d+\.\d+.*?)\.{2,}(\d+)", "$1 $2"),
    (r"(?U)(\d+)[\.\s]+(\d+)[\.\s]+(\d+)\s+([^\n]+)", "$1.$2.$3 $4"),
    (r"(?U)第\s*(\d+)\s*章\s+([^\n]+)", "第$1章 $2"),
    (r"(?U)第\s*(\d+)\s*节\s+([^\n]+)", "第$1节 $2"),
]
# What the scan cleaner unescapes and swaps.
SCAN_SWAPS = [
    ("\\n", "\n"), ("\\t", "    "), ("\\r", ""),
    ("l\\.", "i."), ("O", "0"), ("【", "["), ("】", "]"), ("（", "("), ("）", ")"), ("；", ";"), ("“", '"'), ("”", '"'),
    ("，", ","), ("。", "."), ("：", ":"), ("！", "!"), ("？", "?"), ("＝", "="), ("＋", "+"), ("－", "-"), ("＊", "*"),
    ("／", "/"), ("％", "%"), ("＜", "<"), ("＞", ">"),
]
# Spacing of keywords in scanned code.
SCAN_PATTERNS = [
    (r"(?U)\bif\s*\(", "if ("), (r"(?U)\bfor\s*\(", "for ("), (r"(?U)\bwhile\s*\(", "while ("), (r"(?U)\breturn\s*;", "return;"),
    (r"(?U)\bprintf\s*\(", "printf("), (r"(?U)\bscanf\s*\(", "scanf("),
    (r"(?U)\bint\s+([a-zA-Z_][a-zA-Z0-9_]*)", "int $1"), (r"(?U)\bfloat\s+([a-zA-Z_][a-zA-Z0-9_]*)", "float $1"),
    (r"(?U)\bchar\s+([a-zA-Z_][a-zA-Z0-9_]*)", "char $1"), (r"(?U)\bdouble\s+([a-zA-Z_][a-zA-Z0-9_]*)", "double $1"),
    (r"(?U)\bvoid\s+([a-zA-Z_][a-zA-Z0-9_]*)", "void $1"),
]
# Swaps of the basic cleaner.
BASIC_SWAPS = [("．", "."), ("，", ","), ("：", ":"), ("；", ";"), ("0", "O"), ("l", "i"), ("|", "I")]
# Swaps in concept names and definitions; the last removes all spaces.
NAME_SWAPS = [
    ("属性文祛", "属性文法"), ("语祛分析", "语法分析"), ("词祛分析", "词法分析"), ("正则表达式式", "正则表达式"),
    ("有限状态机机", "有限状态机"), ("自动机机", "自动机"), ("0", "O"), ("l", "I"), (" ", ""),
]
TRAILING_MARK = r"[,\.;:，。；：]$"
# What makes a line look like code.
FENCE_CODE = r"(?i)(if|for|while|switch|int|char|float|double|void|return|printf|scanf)\s*\("
BLOCK_CODE = r"^[{}\[\]();=#<>]|\b(int|float|double|char|void|return|if|for|while|printf)\b|[;{}()]$"


def clean_book_text(text: Column, code: str = FENCE_CODE) -> Column:
    """The book cleaner: swaps, layout patterns, then fences around code lines."""
    return fence_code_lines(rewritten(swapped(text, BOOK_SWAPS), BOOK_PATTERNS), code)


def clean_scanned_text(text: Column) -> Column:
    """The scan cleaner: unescapes, swaps punctuation, normalises the spacing of keywords."""
    return rewritten(swapped(text, SCAN_SWAPS), SCAN_PATTERNS)


def clean_scanned_text_basic(text: Column) -> Column:
    """The basic cleaner: at most one empty line in a row, then swaps."""
    return swapped(F.regexp_replace(text, r"\n{3,}", "\n\n"), BASIC_SWAPS)


def _numbered(text: Column, judged) -> Column:
    """The lines of a text, each with what ``judged`` says of it (``own``) and of the line after (``after``; null for the last)
    and the number of lines that follow. Text, lines and marks are evaluated once, not again for each line or use."""
    zipped = lambda x: F.arrays_zip(x.alias("own"), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))).alias("after"))
    placed = lambda x, n: F.transform(zipped(x), lambda p, i: F.struct(p["own"].alias("own"), p["after"].alias("after"), (n - 1 - i).alias("left")))
    marked = let(F.split(text, "\n", -1), lambda lines: F.transform(lines, judged))
    return let(marked, lambda x: let(F.size(x), lambda n: placed(x, n)))


def _joined(numbered: Column, step) -> Column:
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(numbered, start, step, lambda s: F.array_join(s["out"], "\n"))


def fence_code_lines(text: Column, code: str = FENCE_CODE) -> Column:
    """Opens a fence before the first code line and closes it at a blank line that no code line follows, or at the end."""

    def step(state: Column, x: Column) -> Column:
        opens = x["own"]["code"] & ~state["open"]
        closes = ~opens & state["open"] & x["own"]["blank"] & (x["left"] > 0) & ~x["after"]["code"]
        still = (state["open"] | opens) & ~closes
        line = F.concat(
            F.when(opens, F.lit("```c\n")).otherwise(F.lit("")),
            x["own"]["line"],
            F.when(closes | (still & (x["left"] == 0)), F.lit("\n```")).otherwise(F.lit("")),
        )
        return F.struct(still.alias("open"), F.array_append(state["out"], line).alias("out"))

    return _joined(_numbered(text, lambda x: F.struct(x.alias("line"), x.rlike(code).alias("code"), (strip(x) == "").alias("blank"))), step)


def format_code_blocks(text: Column, code: str = BLOCK_CODE) -> Column:
    """Adds an empty line after each run of code lines that ends at an empty line, or at the line before the last."""

    def step(state: Column, x: Column) -> Column:
        inside = state["open"] | x["own"]["code"]
        closes = inside & (x["left"] > 0) & ((~x["after"]["code"] & x["after"]["blank"]) | (x["left"] == 1))
        out = F.when(closes, F.array(x["own"]["line"], F.lit(""))).otherwise(F.array(x["own"]["line"]))
        return F.struct((inside & ~closes).alias("open"), F.concat(state["out"], out).alias("out"))

    return _joined(_numbered(text, lambda x: let(strip(x), lambda bare: F.struct(x.alias("line"), bare.rlike(code).alias("code"), (bare == "").alias("blank")))), step)


def fix_concept(text: Column) -> Column:
    """A concept name: collapsed, without one trailing mark, with the fixed swaps. Null becomes empty."""
    return F.coalesce(swapped(F.regexp_replace(collapsed(text), TRAILING_MARK, ""), NAME_SWAPS), F.lit(""))


def clean_definition(text: Column) -> Column:
    """A definition: collapsed, with the fixed swaps. Null becomes empty."""
    return F.coalesce(strip(swapped(F.regexp_replace(text, r"(?U)\s+", " "), NAME_SWAPS)), F.lit(""))


def normalize_concept(text: Column) -> Column:
    """Collapsed, without one trailing mark, zeros as the letter O."""
    return F.replace(F.regexp_replace(collapsed(text), TRAILING_MARK, ""), F.lit("0"), F.lit("O"))


def normalize_definition(text: Column) -> Column:
    return F.lower(collapsed(text))


def truncate_text(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _ladder(text: Column, steps: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The name of the first step of which a word occurs in the lower-cased text."""
    low = F.lower(text)
    first = reduce(lambda w, s: w.when(any_of(low, s[1]), s[0]), steps[1:], F.when(any_of(low, steps[0][1]), steps[0][0]))
    return first.otherwise(otherwise)


# Keywords of the intents and actions, in order of precedence.
INTENTS = [
    ("concept_explanation", ["什么是", "解释", "定义", "意思", "概念"]),
    ("problem_solving", ["怎么做", "如何", "计算", "解题", "问题", "题目"]),
    ("motivation", ["不会", "困难", "难", "帮助", "不懂", "鼓励"]),
]
TEACHING_INTENTS = [
    ("concept_explanation", ["什么是", "定义", "解释", "概念"]),
    ("example_request", ["例子", "示例", "举例"]),
    ("misconception_query", ["误区", "常见错误", "容易混淆"]),
    ("related_concepts", ["相关", "类似", "关联"]),
]
ACTIONS = [
    ("greeting", ["你好", "hello"]),
    ("nodding", ["谢谢", "thank"]),
    ("pointing", ["指", "那个", "这个", "point"]),
    ("explaining", ["解释", "explain"]),
]
ASSISTANT_LABELS, STUDENT_LABEL = ["助教:", "Assistant:"], "学生:"
DEFINING_PHRASES = ["是指", "定义为", "是一种"]


def detect_intent(text: Column, steps=INTENTS) -> Column:
    return _ladder(text, steps, "general")


def detect_teaching_intent(text: Column, steps=TEACHING_INTENTS) -> Column:
    return _ladder(text, steps, "general_query")


def tag_actions(text: Column, steps=ACTIONS) -> Column:
    """At most one action, as an array."""
    name = _ladder(text, steps, "")
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array(name))


def extract_defined_concept(text: Column, phrases=DEFINING_PHRASES, most: int = 20) -> Column:
    """What stands before the first of the phrases, if the text has any of them and that is short; else null.

    Only the first phrase splits, so a text that has another one only yields null.
    """
    before = strip(F.substring_index(text, phrases[0], 1))
    return F.when(any_of(text, phrases) & F.contains(text, F.lit(phrases[0])) & (F.length(before) <= most), before)


def strip_role_labels(text: Column, assistants=ASSISTANT_LABELS, student: str = STUDENT_LABEL) -> Column:
    """The text after the first assistant label and before a student label, without lines that begin with a label."""

    def after(label: str) -> Column:
        return strip(F.substring(text, F.instr(text, label) + len(label), F.length(text)))

    picked = reduce(lambda w, a: w.when(F.contains(text, F.lit(a)), after(a)), assistants[1:], F.when(F.contains(text, F.lit(assistants[0])), after(assistants[0])))
    picked = picked.otherwise(text)
    picked = F.when(F.contains(picked, F.lit(student)), strip(F.substring_index(picked, student, 1))).otherwise(picked)
    labels = [student, *assistants]
    lines = F.filter(F.split(picked, "\n", -1), lambda line: ~reduce(lambda a, b: a | b, [F.startswith(line, F.lit(x)) for x in labels]))
    return F.array_join(lines, "\n")
