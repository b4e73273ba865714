"""Mining points (concept, definition) from pages, and judging them.

Points have book_id, seq (input order, for rules by which the first wins), page, concept, definition, importance and
difficulty.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_definition, fix_concept, normalize_definition, strip
from .containment import contained_terms

# Definition patterns; the bracket is a class of characters, not a choice of words.
DEFINITION_PATTERNS = [
    r"([^。.：:\n]{2,20})[是指表示]+(.*?)[。.；;]",
    r"([^。.：:\n]{2,20})[:：](.*?)[。.；;]",
    r"([^。.：:\n]{2,20})的定义是(.*?)[。.；;]",
    r"所谓([^，,]{2,20})，[是指表示]+(.*?)[。.；;]",
]
# Textbook patterns with two groups.
TEXTBOOK_PATTERNS = [
    r"([^。.：:\n]{2,20})[是指表示代表]+(.*?)[。.；;]",
    r"(?:^|\n|(?U:\s))([^。.：:\n]{2,20})[:：](.*?)(?:[。.；;]|\z)",
    r"([^。.：:\n]{2,20})的定义是(.*?)[。.；;]",
    r"所谓([^，,]{2,20})，[是指表示]+(.*?)[。.；;]",
    r"([^-—]{2,20})[—-](.*?)(?:[。.；;]|\z)",
    r"(#include(?U:\s)*<[^>]+>).*?([^。.]*[。.])",
    r"(main\(\)).*?([^。.]*[。.])",
    r"(return(?U:\s)+(?U:\w)+;).*?([^。.]*[。.])",
    r"(int(?U:\s)+(?U:\w)+(?U:\s)*\([^\)]*\)).*?([^。.]*[。.])",
]
# What a text must hold for each of them to match, so that most texts skip most patterns.
TEXTBOOK_GUARDS = ["[是指表示代]", "[:：]", "的定义是", "所谓", "[—-]", "#include", r"main\(\)", "return", r"int(?U:\s)"]
COMMENT_PATTERNS = [r"/\*(?U:\s)*(.*?)(?U:\s)*\*/", r"//(?U:\s)*(.*?)\z"]
CONTROL_PATTERN = r"(if|while|for|switch|do)(?U:\s)*\([^\)]+\)(?U:\s)*\{"
HEADING_PATTERN = r"(?U)(\d+\.\d+(?:\.\d+)?)\s+([^\n]+)"
LIST_ITEM_PATTERN = r"(?U)(?:（|\()(\d+)(?:）|\))([^（\(）\)\d\n]+)"
# Key terms of programming pages.
KEY_TERMS = [
    "变量", "常量", "函数", "循环", "数组", "指针", "结构体", "头文件", "include", "main函数", "return", "if语句", "else语句",
    "while循环", "for循环", "switch语句", "case", "printf函数", "scanf函数", "类型转换", "字符串", "注释", "#define", "宏定义", "标识符",
]
TEMPLATE_CONCEPT = "概念名称"
POINT = "struct<concept:string,definition:string,importance:int,difficulty:int>"


def pattern_matches(pages: DataFrame, pattern: str) -> DataFrame:
    """Matches of a pattern with two groups: book_id, page, match, concept, definition (stripped)."""
    both = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "c"), (2, "d"))])
    found = pages.select("book_id", "page", F.posexplode(both).alias("match", "m"))
    return found.select("book_id", "page", "match", strip(F.col("m.c")).alias("concept"), strip(F.col("m.d")).alias("definition"))


#: What looks at the text around a match: bounds, look-around, places, quoting and flags.
_AROUND = re.compile(r"\\[bBAzZGQ]|\(\?|[$]|(?<!\[)\^|[*+?}]\+")


def _groups(pattern: str) -> Column:
    """Both groups (c, d) of each match of a pattern in ``text``. A pattern that looks at nothing around its match finds the same
    groups in the match alone, so the text is searched once and not again for the second group."""
    both = ((1, "c"), (2, "d"))
    if _AROUND.search(pattern):
        return F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in both])
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return F.transform(matches, lambda m: F.struct(*[F.regexp_extract(m, pattern, g).alias(n) for g, n in both]))


def mine_definitions(
    pages: DataFrame, patterns: list[str] = DEFINITION_PATTERNS, min_concept: int = 2, min_definition: int = 5, cleaned: bool = False
) -> DataFrame:
    """Points from definition patterns, with importance and difficulty 3; ``seq`` orders by page, pattern, match.

    With ``cleaned`` names and definitions go through the cleaners. Pages are read once, whatever the number of patterns.
    """
    per_pattern = [
        F.transform(
            _groups(p), lambda m, i: F.struct(F.lit(k).alias("pattern"), i.alias("match"), strip(m["c"]).alias("concept"), strip(m["d"]).alias("definition"))
        )
        for k, p in enumerate(patterns)
    ]
    found = pages.select("book_id", "page", F.inline(F.concat(*per_pattern)))
    found = valid_pair_filter(found, min_concept, min_definition)
    if cleaned:
        found = found.withColumn("concept", fix_concept(F.col("concept"))).withColumn("definition", clean_definition(F.col("definition")))
    seq = (F.col("page").cast("long") * 100 + F.col("pattern")) * 100_000 + F.col("match")
    return found.select("book_id", seq.alias("seq"), "page", "concept", "definition", F.lit(3).alias("importance"), F.lit(3).alias("difficulty"))


def valid_pair_filter(points: DataFrame, min_concept: int = 2, min_definition: int = 5) -> DataFrame:
    return points.where((F.length("concept") >= min_concept) & (F.length("definition") >= min_definition))


def drop_template_points(points: DataFrame, template: str = TEMPLATE_CONCEPT) -> DataFrame:
    """Without echoes of the prompt's template and without empty definitions."""
    return points.where(~F.col("concept").eqNullSafe(F.lit(template)) & (F.coalesce("definition", F.lit("")) != ""))


def suspicious_definitions(points: DataFrame, max_len: int = 10) -> DataFrame:
    """Non-empty definitions shorter than ``max_len``: book_id, concept, reason, page."""
    short = points.where((F.length("definition") > 0) & (F.length("definition") < max_len))
    return short.select("book_id", "concept", F.lit("short definition").alias("reason"), F.coalesce("page", F.lit(0)).alias("page"))


def extraction_quality(points: DataFrame) -> DataFrame:
    """Per book: total_points, unique_concepts, avg_definition_length (0 for none), coverage (different pages)."""
    return points.groupBy("book_id").agg(
        F.count("*").alias("total_points"),
        F.count_distinct("concept").alias("unique_concepts"),
        F.coalesce(F.sum(F.length(F.coalesce("definition", F.lit("")))) / F.count("*"), F.lit(0.0)).alias("avg_definition_length"),
        F.count_distinct(F.coalesce("page", F.lit(0))).alias("coverage"),
    )


def concept_density(points: DataFrame) -> DataFrame:
    return points.groupBy("book_id", F.coalesce("page", F.lit(0)).alias("page")).agg(F.count("*").alias("points"))


def first_concept_per_page(points: DataFrame) -> DataFrame:
    """The first point of each (book, page, concept) by ``seq``."""
    rest = [c for c in points.columns if c not in ("book_id", "page", "concept")]
    first = points.groupBy("book_id", "page", "concept").agg(F.min_by(F.struct(*rest), "seq").alias("first"))
    return first.select(*[F.col(f"first.{c}").alias(c) if c in rest else F.col(c) for c in points.columns])


def point_score() -> Column:
    """0.6 per character of the definition, 0.3 per step of importance, 0.1 over the page."""
    page = F.greatest(F.lit(1), F.coalesce("page", F.lit(1)))
    return (
        F.length(F.coalesce("definition", F.lit(""))) * F.lit(0.6)
        + F.coalesce("importance", F.lit(3)) * F.lit(0.3)
        + F.lit(1) / page * F.lit(0.1)
    )


def best_point_per_group(points: DataFrame, group: list[str]) -> DataFrame:
    """The point with the highest score of each group; the first by ``seq`` wins ties."""
    best = F.max_by(F.struct(*[c for c in points.columns if c not in group]), F.struct(point_score(), -F.col("seq")))
    return points.groupBy(*group).agg(best.alias("best")).select(*group, "best.*").select(*points.columns)


def collapse_shared_definitions(points: DataFrame) -> DataFrame:
    """Of points of a book with the same normalised definition, that with the highest importance (first wins).

    Points with an empty definition are dropped.
    """
    key = normalize_definition(F.col("definition"))
    order = F.struct(F.coalesce("importance", F.lit(3)), -F.col("seq"))
    best = F.max_by(F.struct(*points.columns), order)
    kept = points.where(F.coalesce("definition", F.lit("")) != "")
    return kept.groupBy("book_id", key.alias("definition_key")).agg(best.alias("best")).select("best.*")


def union_points(*parts: DataFrame) -> DataFrame:
    """All points of all strategies; ``strategy_rank`` keeps their order before ``seq``."""
    ranked = [p.withColumn("strategy_rank", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b), ranked)


def vocabulary_hits(pages: DataFrame, vocabulary: DataFrame, gram: int = 3) -> DataFrame:
    """Terms (domain, term) that occur in a page, case ignored: book_id, page, domain, term."""
    terms = vocabulary.select("domain", F.col("term").alias("named"), F.lower("term").alias("term"))
    texts = pages.select("book_id", "page", F.lower("text").alias("text"))
    hits = contained_terms(texts, ["book_id", "page"], terms, gram).join(terms, "term")  # one row for each term at most of a text
    return hits.select("book_id", "page", "domain", F.col("named").alias("term")).distinct()


def detect_domain(pages: DataFrame, vocabulary: DataFrame, gram: int = 3) -> DataFrame:
    """Per book the domain with the most different terms in its pages: book_id, domain, terms; no row without a hit.

    Ties go to the first domain by name.
    """
    hits = vocabulary_hits(pages, vocabulary, gram).groupBy("book_id", "domain").agg(F.count_distinct("term").alias("terms"))
    best = F.min_by(F.struct("domain", "terms"), F.struct(-F.col("terms"), "domain"))
    return hits.groupBy("book_id").agg(best.alias("best")).select("book_id", "best.domain", "best.terms")


def keyword_context(pages: DataFrame, terms: list[str] = KEY_TERMS, before: int = 20, after: int = 100, default: str = "%s appears on page %d.") -> DataFrame:
    """A point for each key term of a page: what defines it near its first occurrence, else a default sentence."""
    listed = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(t).alias("concept")) for i, t in enumerate(terms)])
    found = pages.select("book_id", "page", "text", F.inline(listed)).where(F.contains("text", "concept"))
    at = F.instr("text", F.col("concept"))
    start = F.greatest(F.lit(1), at - before)
    context = F.substr("text", start, at + F.length("concept") + after - start)
    quoted = F.concat(F.lit(r"\Q"), "concept", F.lit(r"\E[^\n.。]*[是表示:：]([^\n.。]+)[.。]"))
    matched = F.regexp_extract_all(context, quoted, F.lit(1))
    definition = F.coalesce(strip(F.get(matched, F.lit(0))), F.format_string(default, "concept", F.col("page").cast("int")))
    return found.select("book_id", "page", "rank", "concept", definition.alias("definition"))


def mine_textbook(pages: DataFrame, key_terms: list[str] = KEY_TERMS) -> DataFrame:
    """Points from headings, numbered items in their section, code and definition patterns and key terms, in that order.

    Headings have importance 4. Of the patterns and key terms, the first point of a (page, concept) stays and one that a
    heading or item has already is dropped. All are columns of one pass over the pages; list items are cut out of their
    section's text, which reaches to the next heading number.
    """
    page_no = F.col("page") + 1

    def point(rank: int, concept: Column, definition: Column, importance: int = 3) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"), concept.alias("concept"), definition.alias("definition"), F.lit(importance).alias("importance")
        )

    def zipped(text: Column | str, pattern: str, groups: tuple[int, ...]) -> Column:
        return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])

    # A section runs from its heading to the next heading number, so cutting before every number gives the sections.
    pieces = F.split(F.regexp_replace("text", r"(?U)\d+\.\d+(?:\.\d+)?\s+", "\u0000$0"), "\u0000", -1)
    whole = r"(?sU)^(\d+\.\d+(?:\.\d+)?)\s+([^\n]+)(.*)$"
    sections = F.filter(pieces, lambda p: p.rlike(whole))
    title = lambda p: F.regexp_extract(p, whole, 2)
    items = F.transform(
        sections,
        lambda p: F.concat(
            F.array(point(0, strip(title(p)), F.format_string("Section %s on page %d.", F.regexp_extract(p, whole, 1), page_no.cast("int")), 4)),
            F.transform(
                F.filter(zipped(p, LIST_ITEM_PATTERN, (1, 2)), lambda m: F.length(strip(m["g2"])) >= 5),
                lambda m: point(0, F.concat_ws(" ", title(p), F.concat(F.lit("#"), m["g1"])), strip(m["g2"])),
            ),
        ),
    )
    def guarded(guard: str, points: Column) -> Column:
        return F.when(F.col("text").rlike(guard), points).otherwise(F.array().cast(kind))

    kind = "array<struct<rank:int,concept:string,definition:string,importance:int>>"
    pairs = [
        guarded(g, F.transform(zipped("text", p, (1, 2)), lambda m: point(1, strip(m["g1"]), strip(m["g2"]))))
        for g, p in zip(TEXTBOOK_GUARDS, TEXTBOOK_PATTERNS)
    ]
    comments = [
        F.transform(zipped("text", p, (1,)), lambda m: point(1, F.format_string("code on page %d", page_no.cast("int")), strip(m["g1"]))) for p in COMMENT_PATTERNS
    ]
    controls = F.transform(zipped("text", CONTROL_PATTERN, (1,)), lambda m: point(1, F.concat(m["g1"], F.lit(" statement")), F.concat(m["g1"], F.lit(" controls the flow of a program"))))
    listed = F.concat(F.flatten(items), *pairs, *comments, controls)
    found = pages.select("book_id", "page", F.posexplode(listed).alias("pos", "p")).select("book_id", "page", F.col("pos").cast("long").alias("pos"), "p.*")
    found = found.where((F.col("rank") == 0) | ((F.length("concept") >= 2) & (F.length("definition") >= 3)))
    cleaned = found.select(
        "book_id", "page", "pos", "rank", "importance",
        F.when(F.col("rank") == 0, F.col("concept")).otherwise(fix_concept(F.col("concept"))).alias("concept"),
        F.when(F.col("rank") == 0, F.col("definition")).otherwise(clean_definition(F.col("definition"))).alias("definition"),
    )
    keyed = keyword_context(pages, key_terms).select("book_id", "page", (F.col("rank") + 10**6).cast("long").alias("pos"), F.lit(2).alias("rank"), F.lit(3).alias("importance"), "concept", "definition")
    every = cleaned.unionByName(keyed)
    first = F.row_number().over(Window.partitionBy("book_id", "page", "concept").orderBy("rank", "pos"))
    kept = every.withColumn("first", first).where((F.col("rank") == 0) | (F.col("first") == 1))
    return kept.select("book_id", (F.col("page").cast("long") * 10**7 + F.col("pos")).alias("seq"), "page", "concept", "definition", "importance", F.lit(3).alias("difficulty"))
