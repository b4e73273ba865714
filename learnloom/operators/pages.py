"""Pages of books: selection, paragraphs, headings and spans. Pages have book_id, page (0-based) and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .joins import matched

# Heading patterns.
CHAPTER = r"(?U)第\s*(\d+)\s*章\s+([^\n]+)"
SECTION = r"(?U)(\d+)\.(\d+)\s+([^\n]+)"
STRICT_SECTION = r"(?U)(?<![\d.])(\d+)\.(\d+)\s+([^\n]+)"
SPAN_PATTERNS = [
    r"(?U)第\s*(\d+)\s*章\s+([^\n]+)",
    r"(?U)Chapter\s*(\d+)\s*[:：]?\s*([^\n]+)",
    r"(?U)(\d+)\s+([A-Z][A-Za-z\s]+)",
    r"(?U)第\s*(\d+)\s*节\s+([^\n]+)",
]


#: Pages of a book that are numbered together.
RANGE = 1000


def select_pages(pages: DataFrame, start_page: int = 0, max_pages: int | None = None) -> DataFrame:
    """Pages from ``start_page`` on, then the first ``max_pages`` of each book in page order (all if None)."""
    pages = pages.where(F.col("page") >= start_page)
    if max_pages is None:
        return pages
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("page"))
    return pages.withColumn("page_rank", rank).where(F.col("page_rank") <= max_pages).drop("page_rank")


def drop_short_pages(pages: DataFrame, min_chars: int = 50) -> DataFrame:
    """Pages whose stripped text has at least ``min_chars`` characters; a null text has none."""
    return pages.where(F.length(strip(F.col("text"))) >= min_chars)


def split_paragraphs(pages: DataFrame, min_chars: int = 100, separator: str = r"(?U)\n\s*\n") -> DataFrame:
    """One row for each paragraph of more than ``min_chars`` stripped characters: page columns, pos, paragraph."""
    parts = pages.select("book_id", "page", F.posexplode(F.split("text", separator, -1)).alias("pos", "paragraph"))
    return parts.where(F.length(strip(F.col("paragraph"))) > min_chars)


def leading_paragraphs(pages: DataFrame, k: int = 3, min_chars: int = 150, separator: str = r"(?U)\n\s*\n") -> DataFrame:
    """The first ``k`` long paragraphs of each page that has more than one; ``pos`` counts the long ones from 0."""
    kept = F.filter(F.split("text", separator, -1), lambda p: F.length(strip(p)) > min_chars)
    long = pages.select("book_id", "page", kept.alias("kept")).where(F.size("kept") > 1)
    return long.select("book_id", "page", F.posexplode(F.slice("kept", 1, k)).alias("pos", "paragraph"))


def book_text(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One row per book: its pages in order, joined. Meant for books, which fit in a task; not for corpora."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.where("text is not null").groupBy("book_id").agg(F.array_join(ordered["text"], separator).alias("text"))


def headings(pages: DataFrame, pattern: str, groups: int) -> DataFrame:
    """Every match of a heading pattern: book_id, page, pos and g1 .. gn (groups)."""
    parts = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)])
    found = pages.select("book_id", "page", F.posexplode(parts).alias("pos", "m"))
    return found.select("book_id", "page", "pos", *[F.col(f"m.g{g}").alias(f"g{g}") for g in range(1, groups + 1)])


def book_chapters(pages: DataFrame, pattern: str = CHAPTER) -> DataFrame:
    """Chapters (book_id, chapter, title, page): the last page that mentions a number wins, and its last mention."""
    last = F.max_by(F.struct(strip(F.col("g2")).alias("title"), "page"), F.struct("page", "pos"))
    found = headings(pages, pattern, 2).groupBy("book_id", F.col("g1").alias("chapter")).agg(last.alias("last"))
    return found.select("book_id", "chapter", "last.title", "last.page")


def book_sections(pages: DataFrame, pattern: str = SECTION) -> DataFrame:
    """Sections (book_id, section as "c.s", title, page, chapter), by the same rule as chapters."""
    found = headings(pages, pattern, 3)
    last = F.max_by(F.struct(strip(F.col("g3")).alias("title"), "page", F.col("g1").alias("chapter")), F.struct("page", "pos"))
    found = found.groupBy("book_id", F.concat_ws(".", "g1", "g2").alias("section")).agg(last.alias("last"))
    return found.select("book_id", "section", "last.title", "last.page", "last.chapter")


def _chapter_name(prefix: str = "") -> Column:
    return F.concat(F.lit("第"), F.col(f"{prefix}chapter"), F.lit("章 "), F.col(f"{prefix}title"))


def _relation(source: Column, target: Column, relation: str, strength: float) -> list[Column]:
    return [source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(strength).alias("strength")]


def chapter_sequence(chapters: DataFrame) -> DataFrame:
    """Each chapter is a prerequisite of the next known number."""
    order = Window.partitionBy("book_id").orderBy(F.col("chapter").cast("int"), "chapter")
    named = chapters.withColumn("name", _chapter_name()).withColumn("next", F.lead("name").over(order))
    return named.where("next is not null").select("book_id", *_relation(F.col("name"), F.col("next"), "IS_PREREQUISITE_OF", 0.9))


def chapter_includes_sections(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """A known chapter includes its sections."""
    c, s = chapters.alias("c"), sections.alias("s")
    both = c.join(s, F.col("c.book_id").eqNullSafe(F.col("s.book_id")) & (F.col("c.chapter") == F.col("s.chapter")))
    target = F.concat_ws(" ", "s.section", "s.title")
    return both.select("c.book_id", *_relation(_chapter_name("c."), target, "INCLUDES", 0.95))


def section_sequence(sections: DataFrame) -> DataFrame:
    """Within a chapter each section is a prerequisite of the next; 1.10 comes after 1.9."""
    number = F.split("section", r"\.")
    order = Window.partitionBy("book_id", "chapter").orderBy(number[0].cast("int"), number[1].cast("int"), "section")
    named = sections.withColumn("name", F.concat_ws(" ", "section", "title")).withColumn("next", F.lead("name").over(order))
    return named.where("next is not null").select("book_id", *_relation(F.col("name"), F.col("next"), "IS_PREREQUISITE_OF", 0.85))


def chapter_spans(pages: DataFrame, patterns: list[str] = SPAN_PATTERNS) -> DataFrame:
    """Pieces of chapters: book_id, span, title, page, text, in order of (span, page).

    The first pattern that occurs in a book marks its headings. A page's text is cut at its headings; the part before
    its first heading goes on with the span of an earlier page, or belongs to none. A book without headings is one span
    (number 0, no title). A chapter's text is its pieces in order; no row holds more than a page.
    """
    counts = [F.sum(F.regexp_count("text", F.lit(p))).alias(f"n{i}") for i, p in enumerate(patterns)]
    which = reduce(lambda w, i: w.when(F.col(f"n{i}") > 0, i), range(len(patterns)), F.when(F.lit(False), -1)).otherwise(-1)
    chosen = pages.groupBy("book_id").agg(*counts).select("book_id", which.alias("pattern"))
    marked = matched(pages, chosen, ["book_id"])
    # A page is cut before each heading by a mark that cannot stand in a text.
    cut = reduce(
        lambda w, i: w.when(F.col("pattern") == i, F.regexp_replace("text", patterns[i], "\u0000$0")),
        range(len(patterns)),
        F.when(F.col("pattern") < 0, F.col("text")),
    )
    # Headings before a page: those of earlier ranges of pages, and those of earlier pages of its range, so that no task
    # holds a whole book.
    marked = marked.select("book_id", "page", "pattern", F.split(cut, "\u0000", -1).alias("parts"), F.floor(F.col("page") / RANGE).alias("range"))
    starts = F.size("parts") - 1
    own = Window.partitionBy("book_id", "range").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("book_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = marked.groupBy("book_id", "range").agg(F.sum(starts).alias("before"))
    ranges = ranges.select("book_id", "range", F.coalesce(F.sum("before").over(ahead), F.lit(0)).alias("before"))
    counted = marked.withColumn("inside", F.coalesce(F.sum(starts).over(own), F.lit(0)))
    counted = matched(counted, ranges, ["book_id", "range"])
    parts = counted.select("book_id", "page", "pattern", (F.col("before") + F.col("inside")).alias("before"), F.posexplode("parts").alias("pos", "text"))
    numbered = parts.withColumn("span", F.col("before") + F.col("pos")).where((F.col("text") != "") & ((F.col("span") > 0) | (F.col("pattern") < 0)))
    title = reduce(
        lambda w, i: w.when(
            F.col("pattern") == i,
            F.concat(F.lit("第"), F.regexp_extract("text", patterns[i], 1), F.lit("章 "), strip(F.regexp_extract("text", patterns[i], 2))),
        ),
        range(len(patterns)),
        F.when(F.lit(False), ""),
    )
    return numbered.select("book_id", F.col("span"), F.when(F.col("pos") > 0, title).alias("title"), "page", "text")


def failed_pages(pages: DataFrame, points: DataFrame) -> DataFrame:
    """Selected pages without an extracted point."""
    return matched(pages, points.select("book_id", "page").distinct(), ["book_id", "page"], "left_anti")


def assemble_ocr_lines(boxes: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Lines of text from boxes (book_id, page, box_id, x, y, y_bottom, text, page_height): book_id, page, line, text.

    Boxes are taken from top to bottom. A line's anchor is the middle of its first box (for the first line of a page
    the top of its first box); a box whose middle is further from it than ``tolerance`` of the page height begins a new
    line. Boxes of a line are joined from left to right. The anchor depends on all boxes before, so each page is a state
    machine over its sorted boxes; pages are independent.
    """
    top = F.array_sort(F.collect_list(F.struct("y", "box_id", "x", "y_bottom", "text")))
    paged = boxes.groupBy("book_id", "page").agg(top.alias("boxes"), (F.max("page_height") * tolerance).alias("far"))

    def step(state: Column, box: Column) -> Column:
        middle = (box["y"] + box["y_bottom"]) / 2
        anchor = F.coalesce(state["anchor"], box["y"])
        new = F.abs(middle - anchor) > F.col("far")
        line = state["line"] + F.when(new, 1).otherwise(0)
        entry = F.struct(line.alias("line"), box["x"].alias("x"), box["box_id"].alias("box_id"), box["text"].alias("text"))
        return F.struct(F.when(new, middle).otherwise(anchor).alias("anchor"), line.alias("line"), F.array_append(state["out"], entry).alias("out"))

    start = F.struct(
        F.lit(None).cast("double").alias("anchor"),
        F.lit(0).alias("line"),
        F.array().cast("array<struct<line:int,x:double,box_id:bigint,text:string>>").alias("out"),
    )
    placed = paged.select("book_id", "page", F.explode(F.aggregate("boxes", start, step, lambda s: s["out"])).alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("b.x", "b.box_id", "b.text")))
    lines = placed.groupBy("book_id", "page", F.col("b.line").alias("line")).agg(F.array_join(ordered["text"], " ").alias("text"))
    return lines.withColumn("line", F.row_number().over(Window.partitionBy("book_id", "page").orderBy("line")) - 1)
