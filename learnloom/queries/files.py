"""Readers, writers and stored tables on the given tables: what is written is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as src
from ..operators import messages as m
from ..sources.tables import Tables
from ..storage import shared_path, stored
from . import bindings as b
from .registry import ORACLES, QUERIES, query


@query("SELECT source AS book_id, CAST(doc_id AS INT) AS page, coalesce(text, '') AS text FROM documents")
def page_files_round_trip(spark, sf_dir):
    """All documents as page-text files with a line for each page, read in parallel by ranges of bytes."""
    path = shared_path(spark)
    src.write_page_files(b.pages(spark, sf_dir), path)
    return src.read_page_texts(spark, path)


@query(ORACLES["book_structure"])
def book_structure_round_trip(spark, sf_dir):
    from .corpus import _structure

    path = shared_path(spark)
    src.write_book_structure(*_structure(spark, sf_dir), path)
    chapters, sections = src.read_book_structure(spark, path)
    c = chapters.select("book_id", F.lit("chapter").alias("kind"), F.col("chapter").alias("number"), "title", F.col("page").cast("long").alias("page"))
    return c.unionByName(sections.select("book_id", F.lit("section").alias("kind"), F.col("section").alias("number"), "title", F.col("page").cast("long").alias("page")))


@query(f"WITH {b.VOCABULARY} SELECT domain, term FROM vocabulary")
def vocabulary_round_trip(spark, sf_dir):
    path = shared_path(spark)
    src.write_vocabularies(b.vocabulary(spark, sf_dir), path)
    return src.read_vocabularies(spark, path)


_ROUTES = ORACLES["route_messages"]


@query(f"SELECT type, id, error, route FROM ({_ROUTES})")
def messages_round_trip(spark, sf_dir):
    path = shared_path(spark)
    b.messages(spark, sf_dir).select("value").write.text(path)
    return m.route_messages(src.read_messages(spark, path)).select("type", "id", "error", "route")


@query(f"""SELECT 'emotions' AS kind, session_id, CAST(len(labels) AS BIGINT) AS n, labels[1] AS first, joy AS series, NULL AS message FROM ({ORACLES["emotion_series"]})
 UNION ALL SELECT 'learning', session_id, len(labels), labels[1], attention, NULL FROM ({ORACLES["learning_state_series"]})
 UNION ALL SELECT 'log', session_id, seq, NULL, NULL, content FROM ({ORACLES["message_log"]})""")
def monitor_snapshot(spark, sf_dir):
    """The series of emotions and of learning states and the message log, written as a snapshot and read again."""
    path = shared_path(spark)
    parts = [QUERIES[n](spark, sf_dir) for n in ("emotion_series", "learning_state_series", "message_log")]
    src.write_monitor_snapshot(*parts, path)
    emotions, learning, log = src.read_monitor_snapshot(spark, path, *[p.schema for p in parts])
    none = lambda kind: F.lit(None).cast(kind)
    listed = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), "session_id", F.size("labels").cast("long").alias("n"), F.get("labels", F.lit(0)).alias("first"), F.col(c).alias("series"), none("string").alias("message"))
    told = log.select(F.lit("log").alias("kind"), "session_id", F.col("seq").alias("n"), none("string").alias("first"), none("array<double>").alias("series"), F.col("content").alias("message"))
    return listed(emotions, "emotions", "joy").unionByName(listed(learning, "learning", "attention")).unionByName(told)


@query(f"""WITH {b.NODES}, {b.EDGES}, k AS (SELECT * FROM nodes WHERE importance >= 3)
SELECT 'node' AS kind, name, NULL AS target, NULL AS type FROM k UNION ALL SELECT 'edge', src, dst, type FROM edges WHERE src IN (SELECT name FROM k) AND dst IN (SELECT name FROM k)""")
def replace_tables(spark, sf_dir):
    """A stored graph is replaced by a part of itself, both tables in one commit."""
    path = shared_path(spark, "graph")
    src.replace_tables(spark, path, {"nodes": b.nodes(spark, sf_dir), "edges": b.edges(spark, sf_dir)})
    tables = Tables(spark, path)
    kept = tables.read("nodes").where("importance >= 3")
    edges = tables.read("edges")
    for end in ("src", "dst"):
        edges = edges.join(kept.select(F.col("name").alias(end)), end, "left_semi")
    src.replace_tables(spark, path, {"nodes": kept, "edges": edges})
    none = F.lit(None).cast("string")
    rows = tables.read("nodes").select(F.lit("node").alias("kind"), "name", none.alias("target"), none.alias("type"))
    return rows.unionByName(tables.read("edges").select(F.lit("edge").alias("kind"), F.col("src").alias("name"), F.col("dst").alias("target"), "type"))


def _stored(spark, sf_dir, typed):
    """The graph's nodes and its edges of one type are stored; points and raw relations are imported, in two halves."""
    from .graph import _incoming

    tables = Tables(spark, shared_path(spark, "graph"))
    links = stored(b.raw_relations(spark, sf_dir))  # read four times
    edges = b.edges(spark, sf_dir, links).where("type = 'INCLUDES'")
    nodes, key = b.nodes(spark, sf_dir), ["src_label", "src", "dst_label", "dst", "type"] if typed else ["src", "dst", "type"]
    if typed:
        nodes = nodes.unionByName(nodes.where("importance = 1").withColumn("label", F.lit("Example")))
    tables.replace_all({"nodes": nodes, "edges": edges.select(*key, "strength")}, {"nodes": (["label", "name"], 16), "edges": (key, 16)})
    incoming = _incoming(spark, sf_dir)
    last = links.agg(F.max("seq")).first()[0] or 0
    for part in (F.col("seq") <= last // 2, F.col("seq") > last // 2):  # in order, since the first wins
        src.import_graph(tables, incoming.where("false"), links.where(part), typed)
    src.import_graph(tables, incoming, links.where("false"), typed)
    return tables


@query(f"""SELECT 'node' AS kind, label, name, NULL AS target, NULL AS type, importance, NULL AS strength FROM ({ORACLES["merge_nodes_insert_only"]})
 UNION ALL SELECT 'edge', NULL, src, dst, type, NULL, strength FROM ({ORACLES["merge_edges_concepts"]})""")
def import_stored_graph(spark, sf_dir):
    tables = _stored(spark, sf_dir, typed=False)
    none = lambda kind: F.lit(None).cast(kind)
    nodes = tables.read("nodes").select(F.lit("node").alias("kind"), "label", "name", none("string").alias("target"), none("string").alias("type"), "importance", none("double").alias("strength"))
    edges = tables.read("edges").select(F.lit("edge").alias("kind"), none("string").alias("label"), F.col("src").alias("name"), F.col("dst").alias("target"), "type", none("int").alias("importance"), "strength")
    return nodes.unionByName(edges)


@query(ORACLES["merge_edges_any_label"])
def import_stored_labelled_edges(spark, sf_dir):
    return _stored(spark, sf_dir, typed=True).read("edges")
