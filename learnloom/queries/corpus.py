"""Pages, text functions, mining and quality on the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import mining, pages as pg
from . import bindings as b
from .registry import query

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("SELECT source AS book_id, page, text FROM (SELECT source, doc_id AS page, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE doc_id >= 25) WHERE n <= 400")
def select_pages(spark, sf_dir):
    return pg.select_pages(b.pages(spark, sf_dir), 25, 400)


@query(rf"SELECT source AS book_id, doc_id AS page, text FROM documents WHERE length({STRIP.format('text')}) >= 50")
def drop_short_pages(spark, sf_dir):
    return pg.drop_short_pages(b.pages(spark, sf_dir))


LINES = "lines_ AS (SELECT source AS book_id, doc_id AS page, unnest(string_split(text, chr(10))) AS paragraph, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM documents)"


@query(rf"WITH {LINES} SELECT book_id, page, CAST(pos AS INT) AS pos, paragraph FROM lines_ WHERE length({STRIP.format('paragraph')}) > 100")
def split_paragraphs(spark, sf_dir):
    return pg.split_paragraphs(b.pages(spark, sf_dir), 100, "\n")


@query(rf"""WITH {LINES}, long_ AS (SELECT *, row_number() OVER p - 1 AS n, count(*) OVER (PARTITION BY book_id, page) AS total FROM lines_
 WHERE length({STRIP.format('paragraph')}) > 150 WINDOW p AS (PARTITION BY book_id, page ORDER BY pos))
SELECT book_id, page, CAST(n AS INT) AS pos, paragraph FROM long_ WHERE total > 1 AND n < 3""")
def leading_paragraphs(spark, sf_dir):
    return pg.leading_paragraphs(b.pages(spark, sf_dir), 3, 150, "\n")


@query("""SELECT coalesce(source, '') || '/' || (doc_id // 100) AS book_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents
 WHERE text IS NOT NULL GROUP BY ALL""")
def book_text(spark, sf_dir):
    """A book for each hundred documents of a source, so that a book stays of a book's size."""
    book = F.concat_ws("/", F.coalesce("book_id", F.lit("")), F.floor(F.col("page") / 100))
    return pg.book_text(b.pages(spark, sf_dir).withColumn("book_id", book))


CHAPTER, SECTION = r"(\d\d)\d* ([^\n ]+)", r"(\d)(\d)\d* ([^\n ]+)"
HEADINGS = rf"""c_ AS (SELECT source AS book_id, doc_id AS page, unnest(regexp_extract_all(text, '{CHAPTER}', 1)) AS chapter,
  unnest(regexp_extract_all(text, '{CHAPTER}', 2)) AS title, unnest(generate_series(1, len(regexp_extract_all(text, '{CHAPTER}')))) AS pos FROM documents),
chapters AS (SELECT book_id, chapter, arg_max(trim(title), (page, pos)) AS title, arg_max(page, (page, pos)) AS page FROM c_ GROUP BY ALL),
s_ AS (SELECT source AS book_id, doc_id AS page, unnest(regexp_extract_all(text, '{SECTION}', 1)) AS c, unnest(regexp_extract_all(text, '{SECTION}', 2)) AS s,
  unnest(regexp_extract_all(text, '{SECTION}', 3)) AS title, unnest(generate_series(1, len(regexp_extract_all(text, '{SECTION}')))) AS pos FROM documents),
sections AS (SELECT book_id, c || '.' || s AS section, arg_max(trim(title), (page, pos)) AS title, arg_max(page, (page, pos)) AS page, c AS chapter FROM s_ GROUP BY book_id, c, s)"""


def _structure(spark, sf_dir):
    pages = b.pages(spark, sf_dir)
    return pg.book_chapters(pages, CHAPTER), pg.book_sections(pages, SECTION)


@query(f"WITH {HEADINGS} SELECT book_id, 'chapter' AS kind, chapter AS number, title, page FROM chapters UNION ALL SELECT book_id, 'section', section, title, page FROM sections")
def book_structure(spark, sf_dir):
    chapters, sections = _structure(spark, sf_dir)
    c = chapters.select("book_id", F.lit("chapter").alias("kind"), F.col("chapter").alias("number"), "title", "page")
    return c.unionByName(sections.select("book_id", F.lit("section").alias("kind"), F.col("section").alias("number"), "title", "page"))


@query(f"""WITH {HEADINGS} SELECT * FROM (SELECT book_id, '第' || chapter || '章 ' || title AS source, lead('第' || chapter || '章 ' || title) OVER (PARTITION BY book_id ORDER BY CAST(chapter AS INT), chapter) AS target,
 'IS_PREREQUISITE_OF' AS relation, 0.9::DOUBLE AS strength FROM chapters) WHERE target IS NOT NULL""")
def chapter_sequence(spark, sf_dir):
    return pg.chapter_sequence(_structure(spark, sf_dir)[0])


@query(f"""WITH {HEADINGS} SELECT c.book_id, '第' || c.chapter || '章 ' || c.title AS source, s.section || ' ' || s.title AS target, 'INCLUDES' AS relation, 0.95::DOUBLE AS strength
 FROM (SELECT * REPLACE (chapter[1] AS chapter) FROM chapters) c JOIN sections s ON c.book_id = s.book_id AND c.chapter = s.chapter""")
def chapter_includes_sections(spark, sf_dir):
    chapters, sections = _structure(spark, sf_dir)
    return pg.chapter_includes_sections(chapters.withColumn("chapter", F.substring("chapter", 1, 1)), sections)


@query(f"""WITH {HEADINGS} SELECT * FROM (SELECT book_id, section || ' ' || title AS source, lead(section || ' ' || title) OVER (PARTITION BY book_id, chapter ORDER BY CAST(split_part(section, '.', 1) AS INT), CAST(split_part(section, '.', 2) AS INT), section) AS target,
 'IS_PREREQUISITE_OF' AS relation, 0.85::DOUBLE AS strength FROM sections) WHERE target IS NOT NULL""")
def section_sequence(spark, sf_dir):
    return pg.section_sequence(_structure(spark, sf_dir)[1])


SPAN = r"(\d{3})\d* ([^\n ]+)"


@query(rf"""WITH d AS (SELECT source AS book_id, doc_id AS page, string_split(regexp_replace(text, '{SPAN}', chr(1) || '\0', 'g'), chr(1)) AS parts FROM documents),
 p AS (SELECT book_id, page, unnest(parts) AS text, unnest(generate_series(0, len(parts) - 1)) AS pos FROM d),
 n AS (SELECT *, sum(CASE WHEN pos > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page, pos) AS span FROM p)
SELECT book_id, CAST(span AS BIGINT) AS span, CASE WHEN pos > 0 THEN '第' || regexp_extract(text, '{SPAN}', 1) || '章 ' || trim(regexp_extract(text, '{SPAN}', 2)) END AS title, page, text
FROM (SELECT *, max(span) OVER (PARTITION BY book_id) AS most FROM n) WHERE text <> '' AND (span > 0 OR most = 0)""")
def chapter_spans(spark, sf_dir):
    return pg.chapter_spans(b.pages(spark, sf_dir), [r"第\s*(\d+)\s*章\s+([^\n]+)", SPAN])


@query(f"WITH {b.POINTS} SELECT source AS book_id, doc_id AS page FROM documents WHERE doc_id NOT IN (SELECT page FROM points)")
def failed_pages(spark, sf_dir):
    return pg.failed_pages(b.pages(spark, sf_dir).select("book_id", "page"), b.points(spark, sf_dir))


@query(f"WITH {b.POINTS} SELECT book_id, seq, page, concept, definition, importance, difficulty FROM points")
def mine_definitions(spark, sf_dir):
    return b.points(spark, sf_dir)


@query(f"WITH {b.POINTS} SELECT * FROM points WHERE length(concept) >= 4 AND length(definition) >= 20")
def valid_pair_filter(spark, sf_dir):
    return mining.valid_pair_filter(b.points(spark, sf_dir), 4, 20)


@query(f"WITH {b.POINTS} SELECT * FROM points WHERE concept <> 'It' AND definition <> ''")
def drop_template_points(spark, sf_dir):
    return mining.drop_template_points(b.points(spark, sf_dir), "It")


@query(f"WITH {b.POINTS} SELECT book_id, concept, 'short definition' AS reason, page FROM points WHERE length(definition) > 0 AND length(definition) < 10")
def suspicious_definitions(spark, sf_dir):
    return mining.suspicious_definitions(b.points(spark, sf_dir))


@query(f"""WITH {b.POINTS} SELECT book_id, count(*) AS total_points, count(DISTINCT concept) AS unique_concepts, sum(length(definition)) / count(*) AS avg_definition_length,
 count(DISTINCT page) AS coverage FROM points GROUP BY book_id""")
def extraction_quality(spark, sf_dir):
    return mining.extraction_quality(b.points(spark, sf_dir))


@query(f"WITH {b.POINTS} SELECT book_id, page, count(*) AS points FROM points GROUP BY ALL")
def concept_density(spark, sf_dir):
    return mining.concept_density(b.points(spark, sf_dir))


@query(f"WITH {b.POINTS} SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY book_id, page, concept ORDER BY seq) = 1")
def first_concept_per_page(spark, sf_dir):
    return mining.first_concept_per_page(b.points(spark, sf_dir))


@query(f"""WITH {b.POINTS} SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY book_id, concept
 ORDER BY length(definition) * 0.6::DOUBLE + importance * 0.3::DOUBLE + 1.0::DOUBLE / greatest(1, page) * 0.1::DOUBLE DESC, seq) = 1""")
def best_point_per_group(spark, sf_dir):
    return mining.best_point_per_group(b.points(spark, sf_dir), ["book_id", "concept"])


@query(rf"""WITH {b.POINTS} SELECT * FROM points WHERE definition <> '' QUALIFY row_number() OVER (PARTITION BY book_id, lower(regexp_replace(definition, '\s+', ' ', 'g'))
 ORDER BY importance DESC, seq) = 1""")
def collapse_shared_definitions(spark, sf_dir):
    return mining.collapse_shared_definitions(b.points(spark, sf_dir))


@query(rf"""WITH {b.POINTS}, n AS (SELECT * REPLACE (replace(regexp_replace(regexp_replace(concept, '\s+', ' ', 'g'), '[,.;:]$', ''), '0', 'O') AS concept) FROM points),
 k AS (SELECT * FROM n WHERE definition <> '' QUALIFY row_number() OVER (PARTITION BY book_id, lower(regexp_replace(definition, '\s+', ' ', 'g')) ORDER BY importance DESC, seq) = 1)
SELECT book_id, page, count(*) AS points FROM k GROUP BY ALL""")
def corpus_concept_density(spark, sf_dir):
    """The shortest whole path of the corpus plane: mine, normalise, collapse, count."""
    points = b.points(spark, sf_dir).withColumn("concept", tx.normalize_concept(F.col("concept")))
    return mining.concept_density(mining.collapse_shared_definitions(points))


@query(f"WITH {b.POINTS} SELECT *, 0 AS strategy_rank FROM points WHERE importance >= 4 UNION ALL SELECT *, 1 FROM points WHERE difficulty >= 4")
def union_points(spark, sf_dir):
    points = b.points(spark, sf_dir)
    return mining.union_points(points.where("importance >= 4"), points.where("difficulty >= 4"))


@query(f"WITH {b.VOCABULARY} SELECT DISTINCT source AS book_id, doc_id AS page, domain, term FROM documents JOIN vocabulary ON contains(lower(text), lower(term))")
def vocabulary_hits(spark, sf_dir):
    return mining.vocabulary_hits(b.pages(spark, sf_dir), b.vocabulary(spark, sf_dir), 6)


@query(f"""WITH {b.VOCABULARY}, h AS (SELECT source AS book_id, domain, count(DISTINCT term) AS terms FROM documents JOIN vocabulary ON contains(lower(text), lower(term)) GROUP BY ALL)
SELECT book_id, domain, terms FROM h QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY terms DESC, domain) = 1""")
def detect_domain(spark, sf_dir):
    return mining.detect_domain(b.pages(spark, sf_dir), b.vocabulary(spark, sf_dir), 6)


TERMS = ["token", "Licensed", "example"]


@query(rf"""WITH t AS (SELECT * FROM (VALUES (0, 'token'), (1, 'Licensed'), (2, 'example')) AS t(rank, concept)),
 f AS (SELECT source AS book_id, doc_id AS page, rank, concept, text, strpos(text, concept) AS pos FROM documents JOIN t ON contains(text, concept)),
 c AS (SELECT *, substr(text, greatest(1, pos - 20), pos + length(concept) + 100 - greatest(1, pos - 20)) AS context FROM f)
SELECT book_id, page, CAST(rank AS INT) AS rank, concept, coalesce({STRIP.format("nullif(regexp_extract(context, concept || '[^\n.。]*[是表示:：]([^\n.。]+)[.。]', 1), '')")}, concept || ' appears on page ' || page || '.') AS definition FROM c""")
def keyword_context(spark, sf_dir):
    return mining.keyword_context(b.pages(spark, sf_dir), TERMS)


@query()
def mine_textbook(spark, sf_dir):
    return mining.mine_textbook(b.pages(spark, sf_dir), TERMS)


@query()
def clean_book_text(spark, sf_dir):
    """All documents with the default patterns. RE2, which DuckDB uses, has no Unicode classes, so there is no SQL."""
    return b.table(spark, sf_dir, "documents").select("doc_id", tx.clean_book_text(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, replace(replace(replace(replace(regexp_replace(replace(replace(replace(text, '\n', chr(10)), '\t', '    '), '\r', ''), 'l\\\.', 'i.', 'g'), 'O', '0'), '，', ','), '。', '.'), '：', ':') AS text FROM documents""")
def clean_scanned_text(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", tx.clean_scanned_text(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, replace(replace(replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '0', 'O'), 'l', 'i'), '|', 'I') AS text FROM documents""")
def clean_scanned_text_basic(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", tx.clean_scanned_text_basic(F.col("text")).alias("text"))


_LINES = r"""l AS (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)) AS lines FROM documents),
 e AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i, len(lines) AS n, lines FROM l)"""


@query(rf"""WITH {_LINES}, v AS (SELECT *, regexp_matches(line, ',') AS code, trim(line) = '' AND i < n AND NOT regexp_matches(coalesce(lines[i + 1], ''), ',') AS stop FROM e),
 s AS (SELECT *, coalesce(last_value(CASE WHEN code THEN 1 WHEN stop THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v)
SELECT doc_id, string_agg(CASE WHEN code AND before = 0 THEN '```c' || chr(10) ELSE '' END || line ||
  CASE WHEN before = 1 AND stop AND NOT code OR i = n AND (code OR before = 1) THEN chr(10) || '```' ELSE '' END, chr(10) ORDER BY i) AS text FROM s GROUP BY doc_id""")
def fence_code_lines(spark, sf_dir):
    text = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    return b.table(spark, sf_dir, "documents").select("doc_id", tx.fence_code_lines(text, ",").alias("text"))


@query(rf"""WITH {_LINES}, v AS (SELECT *, regexp_matches(line, ',') AS code, i < n AND (trim(coalesce(lines[i + 1], '')) = '' OR i = n - 1) AS stop FROM e),
 s AS (SELECT *, coalesce(last_value(CASE WHEN stop THEN 0 WHEN code THEN 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v)
SELECT doc_id, string_agg(line || CASE WHEN (code OR before = 1) AND stop THEN chr(10) ELSE '' END, chr(10) ORDER BY i) AS text FROM s GROUP BY doc_id""")
def format_code_blocks(spark, sf_dir):
    text = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    return b.table(spark, sf_dir, "documents").select("doc_id", tx.format_code_blocks(text, ",").alias("text"))


@query(rf"""WITH {b.POINTS} SELECT seq, replace(replace(replace(regexp_replace({STRIP.format("regexp_replace(definition, '\\s+', ' ', 'g')")}, '[,.;:]$', ''), '0', 'O'), 'l', 'I'), ' ', '') AS fixed,
 replace(replace(replace(regexp_replace(definition, '\s+', ' ', 'g'), '0', 'O'), 'l', 'I'), ' ', '') AS cleaned, replace(regexp_replace(definition, '[,.;:]$', ''), '0', 'O') AS normal,
 lower(definition) AS low, substr(definition, 1, 15) AS short FROM points""".replace("\\\\s", "\\s"))
def name_cleaners(spark, sf_dir):
    """fix_concept, clean_definition, normalize_concept, normalize_definition and truncate_text on the same column."""
    d = F.col("definition")
    return b.points(spark, sf_dir).select(
        "seq", tx.fix_concept(d).alias("fixed"), tx.clean_definition(d).alias("cleaned"), tx.normalize_concept(d).alias("normal"),
        tx.normalize_definition(d).alias("low"), tx.truncate_text(d, 15).alias("short"),
    )


_FAR = "abs((x.y + x.y_bottom) / 2 - {}) > 20"


@query(f"""WITH RECURSIVE x AS (SELECT l_orderkey AS page, l_linenumber AS box_id, CAST(l_partkey % 600 AS DOUBLE) AS x, l_quantity * 10 AS y, l_quantity * 10 + 20 AS y_bottom, 'w' || l_partkey AS text,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey % 600, l_partkey) AS n FROM lineitem),
 w AS (SELECT page, n, CASE WHEN {_FAR.format('x.y')} THEN (y + y_bottom) / 2 ELSE y END AS anchor, CASE WHEN {_FAR.format('x.y')} THEN 1 ELSE 0 END AS line FROM x WHERE n = 1
  UNION ALL SELECT x.page, x.n, CASE WHEN {_FAR.format('w.anchor')} THEN (x.y + x.y_bottom) / 2 ELSE w.anchor END, w.line + CASE WHEN {_FAR.format('w.anchor')} THEN 1 ELSE 0 END
  FROM w JOIN x ON x.page = w.page AND x.n = w.n + 1),
 l AS (SELECT page, line, string_agg(text, ' ' ORDER BY x, box_id, text) AS text FROM w JOIN x USING (page, n) GROUP BY ALL)
SELECT 'orders' AS book_id, page, CAST(row_number() OVER (PARTITION BY page ORDER BY line) - 1 AS INT) AS line, text FROM l""")
def assemble_ocr_lines(spark, sf_dir):
    """A box for each line of an order, whose quantity is its height on the page."""
    top = F.col("l_quantity") * 10
    boxes = b.table(spark, sf_dir, "lineitem").select(
        F.lit("orders").alias("book_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("box_id"), (F.col("l_partkey") % 600).cast("double").alias("x"),
        top.alias("y"), (top + 20).alias("y_bottom"), F.concat(F.lit("w"), "l_partkey").alias("text"), F.lit(1000.0).alias("page_height"),
    )
    return pg.assemble_ocr_lines(boxes)
