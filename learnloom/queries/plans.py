"""Requests, responses and the cascade on the documents; files that are written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as src
from ..storage import shared_path, stored
from ..operators import mining
from ..plans import extraction as ex
from . import bindings as b
from .registry import query


def _responses(spark, sf_dir):
    """The points of a page as a model might answer, by the page's number: JSON, fenced, inside prose, with single
    quotes and a trailing comma, with bare keys, or one object after another without an array."""
    points = b.points(spark, sf_dir)
    body = F.to_json(F.array_sort(F.collect_list(F.struct("concept", "definition", "importance"))))
    rows = points.groupBy("book_id", "page").agg(body.alias("j"))
    plain = ~F.contains("j", F.lit("'"))  # quotes can be swapped only where none stands within a text
    single = F.regexp_replace(F.replace("j", F.lit('"'), F.lit("'")), r"\}\]$", ", }]")
    bare = F.regexp_replace("j", '"(concept|definition|importance)":', "$1:")
    loose = F.regexp_replace(F.regexp_replace("j", r"^\[|\]$", ""), r"\},\{", "} and {")
    forms = [F.col("j"), F.concat(F.lit("```json\n"), "j", F.lit("\n```")), F.concat(F.lit("Here it is: "), "j", F.lit(" Done.")), F.when(plain, single), F.when(plain, bare), F.when(plain, loose)]
    return rows.select("book_id", "page", F.coalesce(F.get(F.array(*forms), (F.col("page") % 6).cast("int")), "j").alias("response"))


_FIX = "replace(replace(replace(regexp_replace(concept, '[,.;:]$', ''), '0', 'O'), 'l', 'I'), ' ', '')"
_CLEAN = r"replace(replace(replace(regexp_replace(definition, '\s+', ' ', 'g'), '0', 'O'), 'l', 'I'), ' ', '')"


@query(f"WITH {b.POINTS} SELECT book_id, page, {_FIX} AS concept, {_CLEAN} AS definition, importance, CAST(3 AS INT) AS difficulty FROM points")
def parse_point_responses(spark, sf_dir):
    return ex.parse_point_responses(_responses(spark, sf_dir)).drop("seq")


@query(f"WITH {b.EDGES} SELECT src AS book_id, src AS source, dst AS target, type AS relation, strength FROM edges")
def parse_relation_responses(spark, sf_dir):
    edges = b.edges(spark, sf_dir)
    body = F.to_json(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("type").alias("relation"), "strength")))
    responses = edges.groupBy(F.col("src").alias("book_id")).agg(body.alias("response"))
    concepts = edges.select(F.explode(F.array("src", "dst")).alias("concept"))
    return ex.parse_relation_responses(responses, concepts).drop("pos")


@query()
def extraction_requests(spark, sf_dir):
    return ex.extraction_requests(b.pages(spark, sf_dir), b.points(spark, sf_dir), b.vocabulary(spark, sf_dir))


PIECE = r"([A-Za-z]{2,20}) of ([^.\n]{5,}?)\."


@query(rf"""WITH {b.POINTS}, d AS (SELECT * FROM points WHERE importance >= 4 AND difficulty >= 3), v AS (SELECT * FROM points WHERE importance = 3 OR importance >= 4 AND difficulty = 1),
 p AS (SELECT * FROM points WHERE importance >= 4 AND difficulty = 2), t AS (SELECT * FROM points WHERE importance = 2), n AS (SELECT page FROM d GROUP BY page HAVING count(*) >= 2),
 m AS (SELECT * FROM d UNION ALL SELECT * FROM v WHERE page NOT IN (SELECT page FROM n) UNION ALL SELECT * FROM p WHERE page NOT IN (SELECT page FROM n)),
 z_ AS (SELECT source AS book_id, doc_id AS page, unnest(regexp_extract_all(text, '{PIECE}', 1)) AS c, unnest(regexp_extract_all(text, '{PIECE}', 2)) AS e FROM documents)
SELECT book_id, page, concept, definition, 0 AS strategy_rank FROM d UNION ALL SELECT book_id, page, concept, definition, 1 FROM v WHERE page NOT IN (SELECT page FROM n)
UNION ALL SELECT book_id, page, concept, definition, 2 FROM p WHERE page NOT IN (SELECT page FROM n)
UNION ALL SELECT book_id, page, concept, definition, 3 FROM t WHERE page NOT IN (SELECT page FROM m)
UNION ALL SELECT book_id, page, concept, definition, 4 FROM points WHERE page NOT IN (SELECT page FROM m UNION SELECT page FROM t)
UNION ALL SELECT book_id, page, trim(c), trim(e), 5 FROM z_ WHERE length(trim(c)) >= 2 AND length(trim(e)) >= 5 AND page NOT IN (SELECT page FROM points)""")
def strategy_cascade(spark, sf_dir):
    points, pages = stored(b.points(spark, sf_dir)), b.pages(spark, sf_dir)  # stored, or each strategy would mine the texts
    strong, easy = F.col("importance") >= 4, F.col("difficulty")
    pieces = mining.mine_definitions(pages, [PIECE]).select(*points.columns)
    out = ex.strategy_cascade(
        pages, points.where(strong & (easy >= 3)), points.where((F.col("importance") == 3) | strong & (easy == 1)), points.where(strong & (easy == 2)),
        points.where("importance = 2"), pieces, [b.DEFINITION],
    )
    return out.select("book_id", "page", "concept", "definition", "strategy_rank")


@query(f"""WITH {b.POINTS} SELECT 'node' AS kind, concept AS id, 'Concept' AS type, definition, importance, page, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS DOUBLE) AS strength FROM points
 UNION ALL SELECT 'link', concept, 'REFERS_TO', NULL, NULL, NULL, book_id, CASE WHEN page % 2 = 0 THEN 0.25 ELSE 0.5 END FROM points""")
def graph_json_round_trip(spark, sf_dir):
    """Nodes and links are written a row each, gathered to one graph file for each page, and read again."""
    points = b.points(spark, sf_dir)
    weight = F.when(F.col("page") % 2 == 0, 0.25)  # a missing weight is read as 0.5
    relations = points.select(F.col("concept").alias("source"), F.col("book_id").alias("target"), F.lit("REFERS_TO").alias("relation"), weight.alias("strength"))
    path = shared_path(spark)
    src.write_graph_json(points, relations, path)
    nodes, links = (spark.read.schema(s).json(f"{path}/{kind}") for kind, s in (("nodes", src.NODE), ("links", src.LINK)))
    own = nodes.select(F.lit("node").alias("kind"), F.pmod(F.xxhash64("id"), F.lit(8)).alias("file"), F.to_json(F.struct(*nodes.columns)).alias("j"))
    own = own.unionByName(links.select(F.lit("link").alias("kind"), F.pmod(F.xxhash64("source"), F.lit(8)).alias("file"), F.to_json(F.struct(*links.columns)).alias("j")))
    part = lambda kind: F.array_join(F.collect_list(F.when(F.col("kind") == kind, F.col("j"))), ",")
    files = own.groupBy("file").agg(F.concat(F.lit('{"nodes": ['), part("node"), F.lit('], "links": ['), part("link"), F.lit("]}")).alias("value"))
    files.select("value", "file").write.partitionBy("file").text(f"{path}/graphs")
    nodes, links = src.read_graph_json(spark, f"{path}/graphs/*/*")
    none = lambda kind: F.lit(None).cast(kind)
    one = nodes.select(F.lit("node").alias("kind"), "id", "type", "definition", "importance", F.col("page").cast("long").alias("page"), none("string").alias("target"), none("double").alias("strength"))
    return one.unionByName(links.select(F.lit("link").alias("kind"), F.col("source").alias("id"), "type", none("string").alias("definition"), none("int").alias("importance"), none("long").alias("page"), "target", "strength"))


@query(f"WITH {b.POINTS} SELECT book_id, seq, page, CAST(floor((dense_rank() OVER (PARTITION BY book_id ORDER BY page) - 1) / 10) AS INT) AS batch FROM points")
def point_batches(spark, sf_dir):
    path = shared_path(spark)
    src.write_point_batches(b.points(spark, sf_dir), path)
    return spark.read.parquet(path).select("book_id", "seq", "page", F.col("batch").cast("int").alias("batch"))


@query("SELECT source AS book_id, doc_id AS page, text FROM documents")
def page_texts_round_trip(spark, sf_dir):
    path = shared_path(spark)
    src.write_page_texts(b.pages(spark, sf_dir), path)
    return spark.read.parquet(path).select("book_id", "page", "text")
