"""Lookups, neighbours, merges and paths in the graph of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..plans import planning
from ..storage import stored
from . import bindings as b
from .registry import query


@query(f"WITH {b.NODES}, {b.MASTERY}, {b.REQUESTS} SELECT * FROM nodes WHERE name IN (SELECT concept FROM requests)")
def get_concept(spark, sf_dir):
    return g.get_concept(b.nodes(spark, sf_dir), g.names_of("concept", b.requests(spark, sf_dir)))


@query(f"WITH {b.NODES} SELECT * FROM nodes WHERE contains(name, '17') ORDER BY name LIMIT 10")
def search_concepts(spark, sf_dir):
    return g.search_concepts(b.nodes(spark, sf_dir), "17")


@query(f"""WITH {b.RELATIONS} SELECT source, target, relation, strength, seq FROM raw_relations WHERE relation <> 'IS_RELATED_TO' AND source <> '1'""")
def drop_invalid_links(spark, sf_dir):
    raw = b.raw_relations(spark, sf_dir)
    raw = raw.withColumn("relation", F.when(F.col("relation") != "IS_RELATED_TO", F.col("relation"))).withColumn("source", F.when(F.col("source") == "1", "").otherwise(F.col("source")))
    return g.drop_invalid_links(raw)


@query(f"WITH {b.NODES} SELECT * FROM nodes WHERE importance <> 2")
def drop_invalid_nodes(spark, sf_dir):
    return g.drop_invalid_nodes(b.nodes(spark, sf_dir).withColumn("name", F.when(F.col("importance") != 2, F.col("name"))))


@query(f"""WITH {b.NODES}, {b.EDGES}, {b.MASTERY}, {b.REQUESTS} SELECT src, n.name, type, strength, subject, difficulty, importance, description
 FROM edges e JOIN nodes n ON e.dst = n.name WHERE src IN (SELECT concept FROM requests) QUALIFY row_number() OVER (PARTITION BY src ORDER BY n.name, type) <= 5""")
def related_concepts(spark, sf_dir):
    names = g.names_of("concept", b.requests(spark, sf_dir))
    edges = b.edges(spark, sf_dir).drop("src_label", "dst_label")
    return g.related_concepts(edges, b.nodes(spark, sf_dir), names)


@query(f"""WITH {b.EXAMPLES}, {b.MASTERY}, {b.REQUESTS} SELECT concept, name, relevance, row_number() OVER (PARTITION BY concept ORDER BY relevance DESC, name) AS place
 FROM examples WHERE concept IN (SELECT concept FROM requests) QUALIFY place <= 3""")
def concept_examples(spark, sf_dir):
    return g.concept_examples(b.examples(spark, sf_dir), g.names_of("concept", b.requests(spark, sf_dir)))


@query(f"""WITH {b.EXAMPLES}, {b.MASTERY}, {b.REQUESTS} SELECT concept, name, frequency, row_number() OVER (PARTITION BY concept ORDER BY frequency DESC, name) AS place
 FROM examples WHERE concept IN (SELECT concept FROM requests) QUALIFY place <= 3""")
def concept_misconceptions(spark, sf_dir):
    return g.concept_misconceptions(b.examples(spark, sf_dir), g.names_of("concept", b.requests(spark, sf_dir)))


@query(f"""WITH {b.NODES}, {b.EDGES} SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type
 UNION ALL SELECT 'nodes', 'all', count(*) FROM nodes""")
def graph_counts(spark, sf_dir):
    return g.graph_counts(b.nodes(spark, sf_dir), b.edges(spark, sf_dir))


def _incoming(spark, sf_dir):
    """Points as nodes to import: concepts by name, every fifth of another type, some numbers that exist already."""
    points = b.points(spark, sf_dir)
    return points.select(
        "seq", F.col("concept").alias("id"), F.when(F.col("page") % 3 == 0, F.col("page").cast("string")).otherwise(F.col("concept")).alias("name"),
        F.when(F.col("importance") == 5, "Example").otherwise("Concept").alias("type"), "definition", F.lit(None).cast("int").alias("difficulty"), "importance",
    )


_INCOMING = """incoming AS (SELECT seq, concept AS id, CASE WHEN page % 3 = 0 THEN CAST(page AS VARCHAR) ELSE concept END AS name,
 CASE WHEN importance = 5 THEN 'Example' ELSE 'Concept' END AS type, definition, importance FROM points)"""


@query(f"""WITH {b.POINTS}, {b.NODES}, {_INCOMING} SELECT * FROM nodes UNION ALL SELECT 'Concept', name, 'imported', 3, arg_min(importance, seq), arg_min(definition, seq)
 FROM incoming WHERE type = 'Concept' AND name NOT IN (SELECT name FROM nodes) GROUP BY name""")
def merge_nodes_insert_only(spark, sf_dir):
    return g.merge_nodes_insert_only(b.nodes(spark, sf_dir), _incoming(spark, sf_dir))


@query(f"""WITH {b.POINTS}, {b.NODES}, {_INCOMING} SELECT * FROM nodes UNION ALL SELECT type, name, '', 3, arg_min(importance, seq), arg_min(definition, seq)
 FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.label = i.type AND n.name = i.name) GROUP BY type, name""")
def merge_nodes_typed(spark, sf_dir):
    return g.merge_nodes_typed(b.nodes(spark, sf_dir), _incoming(spark, sf_dir))


def _split(spark, sf_dir):
    """The graph's edges of one type are there already; the raw relations are imported."""
    edges = b.edges(spark, sf_dir).where("type = 'INCLUDES'")
    return edges, b.nodes(spark, sf_dir), b.raw_relations(spark, sf_dir)


@query(f"""WITH {b.EDGES}, {b.NODES} SELECT * FROM edges WHERE type = 'INCLUDES' UNION ALL SELECT source, target, relation, arg_min(strength, seq) FROM raw_relations
 WHERE relation <> 'INCLUDES' AND source IN (SELECT name FROM nodes) AND target IN (SELECT name FROM nodes) GROUP BY ALL""")
def merge_edges_concepts(spark, sf_dir):
    return g.merge_edges_concepts(*_split(spark, sf_dir))


@query(f"""WITH {b.EDGES}, {b.NODES}, two AS (SELECT label, name FROM nodes UNION ALL SELECT 'Example', name FROM nodes WHERE importance = 1)
SELECT 'Concept' AS src_label, src, 'Concept' AS dst_label, dst, type, strength FROM edges WHERE type = 'INCLUDES' UNION ALL
SELECT a.label, source, c.label, target, relation, arg_min(strength, seq) FROM raw_relations r JOIN two a ON a.name = source JOIN two c ON c.name = target
 WHERE NOT (a.label = 'Concept' AND c.label = 'Concept' AND relation = 'INCLUDES') GROUP BY ALL""")
def merge_edges_any_label(spark, sf_dir):
    edges, nodes, raw = _split(spark, sf_dir)
    two = nodes.unionByName(nodes.where("importance = 1").withColumn("label", F.lit("Example")))
    return g.merge_edges_any_label(edges, two, raw)


@query(f"""WITH {b.POINTS}, {b.EDGES}, {b.NODES}, {_INCOMING} SELECT 'nodes' AS kind, (SELECT count(*) FROM incoming) AS accepted,
 (SELECT count(DISTINCT name) FROM incoming WHERE type = 'Concept' AND name NOT IN (SELECT name FROM nodes)) AS created
UNION ALL SELECT 'links', (SELECT count(*) FROM raw_relations), (SELECT count(*) FROM edges WHERE type <> 'INCLUDES')""")
def import_counts(spark, sf_dir):
    edges, nodes, raw = _split(spark, sf_dir)
    incoming = stored(_incoming(spark, sf_dir))  # counted and merged: the texts are mined once
    return g.import_counts(incoming, raw, g.merge_nodes_insert_only(nodes, incoming), g.merge_edges_concepts(edges, nodes, raw), nodes, edges)


_PAIRS = "pairs AS (SELECT DISTINCT concept AS start, target FROM requests WHERE concept <> target)"


@query(f"""WITH RECURSIVE {b.EDGES}, {b.MASTERY}, {b.REQUESTS}, {_PAIRS}, step AS (SELECT DISTINCT src, dst FROM edges),
 walk AS (SELECT DISTINCT start, start AS name, 0 AS depth FROM pairs UNION SELECT w.start, s.dst, w.depth + 1 FROM walk w JOIN step s ON s.src = w.name WHERE w.depth < 5),
 level AS (SELECT start, name, min(depth) AS depth FROM walk GROUP BY ALL),
 parent AS (SELECT l.start, l.name, l.depth, min(p.name) AS parent FROM level l JOIN step s ON s.dst = l.name JOIN level p ON p.start = l.start AND p.name = s.src AND p.depth = l.depth - 1 GROUP BY ALL),
 back AS (SELECT q.start, q.target, p.depth AS step, p.parent AS src, p.name AS dst FROM pairs q JOIN parent p ON p.start = q.start AND p.name = q.target
  UNION ALL SELECT k.start, k.target, p.depth, p.parent, p.name FROM back k JOIN parent p ON p.start = k.start AND p.name = k.src WHERE k.step > 1)
SELECT start, target, step, k.src, k.dst, arg_min(type, type) AS type, arg_min(strength, type) AS strength FROM back k JOIN edges e ON e.src = k.src AND e.dst = k.dst GROUP BY ALL""")
def shortest_learning_path(spark, sf_dir):
    pairs = b.requests(spark, sf_dir).select(F.col("concept").alias("start"), "target")
    return g.shortest_learning_path(b.stored_edges(spark, sf_dir), pairs)


@query(f"""WITH {b.NODES}, {b.EDGES}, s AS (SELECT name FROM nodes), o AS (SELECT DISTINCT src AS state, dst AS action FROM edges WHERE src IN (SELECT name FROM s)),
 k AS (SELECT name FROM s WHERE name NOT IN (SELECT state FROM o)) SELECT state, action FROM o UNION ALL SELECT k.name, n.name FROM k JOIN nodes n ON contains(n.name, k.name) AND n.name <> k.name""")
def available_actions(spark, sf_dir):
    nodes = b.nodes(spark, sf_dir)
    return planning.available_actions(nodes, b.edges(spark, sf_dir), nodes)


@query(f"""WITH {b.NODES}, {b.EDGES}, {b.MASTERY}, {b.REQUESTS}, a AS (SELECT r.student_id, e.src, e.dst FROM requests r JOIN edges e ON e.src = r.concept)
SELECT DISTINCT a.student_id, a.src, a.dst, round(CASE WHEN n.name IS NULL THEN -1.0::DOUBLE ELSE 0.4::DOUBLE * (1 - abs(n.difficulty / 5 - least(coalesce(h.mastery, 0) + 0.2::DOUBLE, 0.9::DOUBLE)))
 + 0.3::DOUBLE * n.importance / 5 + 0.3::DOUBLE * (1 - coalesce(t.mastery, 0)) END, 6) AS reward FROM a LEFT JOIN nodes n ON n.name = a.dst
 LEFT JOIN mastery h ON h.student_id = a.student_id AND h.concept = a.src LEFT JOIN mastery t ON t.student_id = a.student_id AND t.concept = a.dst""")
def edge_reward(spark, sf_dir):
    asked = b.requests(spark, sf_dir).select("student_id", F.col("concept").alias("src"))
    moves = asked.join(b.edges(spark, sf_dir).select("src", "dst").distinct(), "src")
    rewards = planning.edge_reward(moves, b.nodes(spark, sf_dir), b.mastery(spark, sf_dir))
    return rewards.select("student_id", "src", "dst", F.round("reward", 6).alias("reward"))


def _goals(spark, sf_dir):
    return b.requests(spark, sf_dir).select(F.col("student_id").alias("goal_id"), "student_id", F.col("concept").alias("start"), "target")


def _graph(spark, sf_dir):
    return b.edges(spark, sf_dir), b.nodes(spark, sf_dir), b.mastery(spark, sf_dir)


@query()
def learn_q_values(spark, sf_dir):
    """The values of the moves from each goal's start; they rest on those of all states within ten moves of it."""
    values = planning.learn_q_values(_goals(spark, sf_dir), *_graph(spark, sf_dir), starts_only=True)
    return values.withColumn("q", F.round("q", 4))


@query()
def greedy_rollout(spark, sf_dir):
    """Paths of up to ten best moves, with what is known of each concept."""
    rows = planning.planned_paths(_goals(spark, sf_dir), *_graph(spark, sf_dir)).drop("student_id")
    return rows.withColumn("mastery", F.round("mastery", 6))
