"""Extraction with a model outside: the requests to send, the stored responses to parse, and the cascade of strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_definition, fix_concept
from ..operators import mining, pages as pg
from ..operators.containment import occurrences
from ..operators.joins import matched
from ..operators.relations import top_concepts_by_importance, validate_relation_endpoints

POINT_JSON = "array<struct<concept:string,definition:string,importance:string,difficulty:string>>"
RELATION_JSON = "array<struct<source:string,target:string,relation:string,strength:double>>"


#: Characters of a page for one request, and for one on vocabulary terms.
DIRECT, SHARED = 1500, 3000


def _unfenced(response: Column) -> Column:
    return F.trim(F.regexp_replace(response, r"```(json)?", ""))


# Repairs of broken JSON, in order.
REPAIRS = [(r"'", '"'), (r",\s*\}", "}"), (r",\s*\]", "]"), (r"(\w+):", '"$1":')]
SECOND_REPAIRS = [
    (r'("[^"]+")(\s*)([^:"\s{}\[\]]+)(\s*)([:,])', "$1$2:$3$4$5"),
    (r':(\s*)([^"{}\[\],\d][^,}\]]*?)([,}\]])', ':$1"$2"$3'),
]
# Where a response holds its array, or its objects.
ARRAY, OBJECT = r"(?s)\[\s*\{.*?\}\s*\]", r'(?s)\{\s*"concept".*?\}'


def _repaired(text: Column) -> Column:
    """Double quotes, no trailing commas, quoted keys."""
    for pattern, to in REPAIRS:
        text = F.regexp_replace(text, pattern, to)
    return text


def _repaired_again(text: Column) -> Column:
    """Colons after keys and quotes around bare values."""
    for pattern, to in SECOND_REPAIRS:
        text = F.regexp_replace(text, pattern, to)
    return text


def _first_array(response: Column) -> Column:
    """The first JSON array of objects in a text, else all its objects as one array, else empty."""
    array = F.regexp_extract(response, ARRAY, 0)
    objects = F.regexp_extract_all(response, F.lit(OBJECT), F.lit(0))
    return F.when(array != "", array).when(F.size(objects) > 0, F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]"))).otherwise("")


def parse_point_responses(responses: DataFrame) -> DataFrame:
    """Points of stored responses (book_id, page, response).

    The whole response as JSON; else its first array, or its objects, repaired once and then again; else what
    ``mine_textbook`` finds in it. Importance and difficulty that are not whole numbers become 3. Echoes of the template
    and empty definitions are dropped.
    """
    text = F.coalesce("response", F.lit(""))
    # An object is not an array of one, and objects after it would be lost.
    array = F.when(_unfenced(text).startswith("["), _unfenced(text))
    staged = responses.withColumn("whole", F.from_json(array, POINT_JSON)).withColumn("part", _first_array(text))
    staged = staged.withColumn("first", F.from_json(_repaired(F.col("part")), POINT_JSON)).withColumn(
        "second", F.from_json(_repaired_again(_repaired(F.col("part"))), POINT_JSON)
    )
    good = lambda c: F.when(F.coalesce(F.exists(c, lambda p: p["concept"].isNotNull() | p["definition"].isNotNull()), F.lit(False)) | (F.size(c) == 0), F.col(c))
    staged = staged.withColumn("points", F.coalesce(good("whole"), good("first"), good("second")))
    number = lambda c: F.when(F.col(c).rlike(r"^-?\d+$"), F.col(c).cast("int")).otherwise(3).alias(c)
    parsed = staged.where("points is not null").select("book_id", "page", F.posexplode("points").alias("pos", "p")).select("book_id", "page", "pos", "p.*")
    kept = mining.drop_template_points(parsed)
    own = kept.select(
        "book_id", (F.col("page").cast("long") * 10**7 + F.col("pos")).alias("seq"), "page", fix_concept(F.col("concept")).alias("concept"),
        clean_definition(F.col("definition")).alias("definition"), number("importance"), number("difficulty"),
    )
    lost = staged.where("points is null").select("book_id", "page", F.col("response").alias("text"))
    return own.unionByName(mining.mine_textbook(lost).select(*own.columns))


def parse_relation_responses(responses: DataFrame, concepts: DataFrame) -> DataFrame:
    """Relations of stored responses, whole or repaired, whose ends are among the concepts of the request."""
    text = F.coalesce("response", F.lit(""))
    part = F.regexp_extract(text, r"(?s)\[\s*\{.*\}\s*\]", 0)
    found = F.coalesce(F.from_json(_unfenced(text), RELATION_JSON), F.from_json(_repaired(part), RELATION_JSON))
    rows = responses.select("book_id", F.posexplode(found).alias("pos", "r")).select("book_id", "pos", "r.*")
    return validate_relation_endpoints(rows, concepts)


def extraction_requests(pages: DataFrame, points: DataFrame, vocabulary: DataFrame, batch: int = 5) -> DataFrame:
    """What to ask a model: book_id, page, strategy, part, prompt.

    One request per 1500 characters of a page (part is the chunk's number), one per ``batch`` vocabulary terms that begin
    in each 3000 characters of a page (whose text runs on as far as the longest term; places are those of the text in lower
    case), one per leading paragraph, and one on relations between the 25 most important concepts of a book (page is null).
    The vocabulary is sent to the pages.
    """
    ask = lambda head, body: F.concat_ws("\n", F.lit(head), body)
    size = F.coalesce(F.length("text"), F.lit(0))
    last = F.greatest(F.ceil(size / DIRECT).cast("int"), F.lit(1)) - 1
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.substr("text", k * DIRECT + 1, F.lit(DIRECT)))
    direct = pages.select("book_id", "page", F.posexplode(chunks).alias("part", "chunk"))
    direct = direct.select("book_id", "page", F.lit("direct").alias("strategy"), "part", ask("List concepts and definitions as JSON.", F.col("chunk")).alias("prompt"))
    # Each text is read once for the chunks in which terms begin; chunks are then cut out of the texts by arithmetic.
    terms = vocabulary.select(F.lower("term").alias("term"), F.col("term").alias("named"))
    longest = terms.agg(F.max(F.length("term"))).first()[0] or 1
    found = occurrences(pages.select("book_id", "page", F.lower("text").alias("text")), ["book_id", "page"], terms, size=SHARED)
    found = found.join(terms, "term").repartition("book_id", "page")
    named = found.groupBy("book_id", "page", "slot").agg(F.sort_array(F.collect_set("named")).alias("t"))
    batches = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / batch).cast("int")), lambda n: F.struct("slot", n.alias("n"), F.array_join(F.slice("t", n * batch + 1, batch), ", ").alias("terms")))
    asked = named.select("book_id", "page", F.inline(batches)).groupBy("book_id", "page").agg(F.sort_array(F.collect_list(F.struct("slot", "n", "terms"))).alias("asked"))
    body = F.transform("asked", lambda a: F.concat_ws("\n", F.concat(F.lit("Define as JSON: "), a["terms"]), F.substr("text", a["slot"] * SHARED + 1, F.lit(SHARED + longest - 1))))
    asked = matched(pages.select("book_id", "page", "text"), asked, ["book_id", "page"]).select("book_id", "page", F.lit("vocabulary").alias("strategy"), F.posexplode(body).alias("part", "prompt"))
    paragraphs = pg.leading_paragraphs(pages, separator="\n").select("book_id", "page", F.lit("paragraph").alias("strategy"), F.col("pos").alias("part"), ask("List concepts and definitions as JSON.", F.col("paragraph")).alias("prompt"))
    top = top_concepts_by_importance(points).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("place", "concept"))).alias("c"))
    related = top.select("book_id", F.lit(None).cast("long").alias("page"), F.lit("relations").alias("strategy"), F.lit(0).alias("part"), ask("Relate these concepts as JSON.", F.array_join(F.transform("c", lambda x: x["concept"]), ", ")).alias("prompt"))
    every = direct.withColumn("page", F.col("page").cast("long"))
    for part in (asked, paragraphs, related):
        every = every.unionByName(part.withColumn("page", F.col("page").cast("long")))
    return every


def strategy_cascade(
    pages: DataFrame, direct: DataFrame, vocabulary: DataFrame, paragraph: DataFrame, retry: DataFrame, pieces: DataFrame,
    patterns: list[str] = mining.DEFINITION_PATTERNS,
) -> DataFrame:
    """The points that count for each page, with ``strategy_rank`` from 0: direct, vocabulary, paragraph, retry, patterns, pieces.

    Two or more direct points stand alone; fewer are joined by those of vocabulary and leading paragraphs. A page without
    any of the three gets the points of the second request (``retry``); without these, what the definition patterns
    find; and without these, the points of its paragraphs of over 100 characters, one request each (``pieces``).
    """
    key = ["book_id", "page"]
    without = lambda points, *found: _left(points, key, *found)
    enough = direct.groupBy(*key).agg(F.count("*").alias("n")).where("n >= 2").select(*key)
    more = mining.union_points(direct, without(vocabulary, enough), without(paragraph, enough))
    again = without(retry, more)
    mined = mining.mine_definitions(without(pages, more, retry), patterns).select(*direct.columns)
    last = without(pieces, more, retry, mined)
    for rank, part in ((3, again), (4, mined), (5, last)):
        more = more.unionByName(part.withColumn("strategy_rank", F.lit(rank)))
    return more


def _left(rows: DataFrame, key: list[str], *found: DataFrame) -> DataFrame:
    """The rows of pages that have none of the points found."""
    for f in found:
        rows = matched(rows, f.select(*key).distinct(), key, "left_anti")
    return rows
