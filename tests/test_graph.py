import random

import pytest
from pyspark.sql import functions as F

from learnloom import sources as src
from learnloom.operators import graph as g, recommend as r, relations as rel, similarity as sim
from learnloom.operators.containment import contained_terms
from learnloom.plans import extraction as ex, planning


def test_contained_terms_match_brute_force(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("abcd") for _ in range(rng.randrange(40)))) for i in range(60)]
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(50)})
    got = contained_terms(spark.createDataFrame(texts, "id long, text string"), ["id"], spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert {(x["id"], x["term"]) for x in got} == {(i, t) for i, s in texts for t in terms if t in s}


def test_similar_groups_match_the_sequential_definition(spark):
    rng = random.Random(7)
    stems = ["recursion", "derivative", "integral", "variables"]
    names = []
    for _ in range(90):
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("abcdefg")
        names.append("".join(w))
    rows = list(enumerate(names))
    points = spark.createDataFrame([("b", i, n) for i, n in rows], "book_id string, seq long, concept string")
    got = {x["seq"]: x["leader"] for x in sim.group_similar_concepts(points).collect()}
    first = {}
    for i, n in rows:
        first.setdefault(n, i)
    want = sim.brute_force_groups(((i, n) for n, i in first.items()))
    assert got == {i: want[first[n]] for i, n in rows}
    pairs = {(x["i"], x["j"]) for x in sim.near_duplicate_concepts(points).collect()}
    distinct = sorted((i, n) for n, i in first.items())
    assert pairs == {(i, j) for i, a in distinct for j, b in distinct if i < j and sim.sequence_ratio(a, b) > 0.8}


def test_rows_of_similar_names_are_not_broadcast(spark, monkeypatch):
    """However small the stored names are: their rows are many times as many, and their pairs too."""
    plans, keep = [], sim.stored
    monkeypatch.setattr(sim, "stored", lambda df: plans.append(df) or keep(df))
    points = spark.createDataFrame([("b", i, n) for i, n in enumerate(["recursion", "recursive", "integral", "integrals"])], "book_id string, seq long, concept string")
    pairs = sim.near_duplicate_concepts(points)
    for df in (plans[-1], pairs):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["i"], r["j"]) for r in pairs.collect()] == [(2, 3)]


CONCEPTS = [("function", 3, 5), ("derivative", 4, 5), ("integral", 4, 5), ("limit", 4, 4), ("variable", 2, 4), ("loop", 2, 4), ("recursion", 4, 4)]
EDGES = [
    ("function", "derivative", "IS_PREREQUISITE_OF", 1.0), ("function", "integral", "IS_PREREQUISITE_OF", 1.0), ("limit", "derivative", "IS_PREREQUISITE_OF", 0.9),
    ("derivative", "integral", "IS_RELATED_TO", 0.9), ("variable", "loop", "IS_PREREQUISITE_OF", 0.8), ("loop", "recursion", "IS_RELATED_TO", 0.7),
]


@pytest.fixture
def small(spark):
    rows = [("Concept", n, "s", d, i, n) for n, d, i in CONCEPTS]
    nodes = spark.createDataFrame(rows, "label string, name string, subject string, difficulty int, importance int, description string")
    return nodes, spark.createDataFrame(EDGES, "src string, dst string, type string, strength double")


def test_seed_graph(spark):
    nodes, edges = src.seed_graph(spark)
    assert {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()} == {"Concept": 8, "Example": 4, "Misconception": 2}
    assert edges.count() == 13 and edges.where("src_label is null or dst_label is null").count() == 0
    requests = spark.createDataFrame([(1, "array")], "student_id long, concept string")
    mastery = spark.createDataFrame([], "student_id long, concept string, mastery double")
    got = {x["name"]: x["score"] for x in r.recommend_related_concepts(requests, edges, nodes, mastery, limit=9).collect()}
    assert got == {"hash table": 0.88, "stack": 0.8, "heap": 0.75}


def test_recommendation_scores(spark, small):
    nodes, edges = small
    requests = spark.createDataFrame([(1, "function")], "student_id long, concept string")
    mastery = spark.createDataFrame([], "student_id long, concept string, mastery double")
    got = {x["name"]: x["score"] for x in r.recommend_related_concepts(requests, edges, nodes, mastery).collect()}
    # difficulty 4, importance 5, strength 1: 0.3 + 0.3 + 0.2 (1 - 0.8 * 0.5) + 0.2
    assert got == {"derivative": 0.92, "integral": 0.92}


def test_edge_reward_golden(spark):
    nodes = spark.createDataFrame([("Concept", "b", 3, 5)], "label string, name string, difficulty int, importance int")
    edges = spark.createDataFrame([("a", "b"), ("a", "z")], "src string, dst string").withColumn("student_id", F.lit(1))
    mastery = spark.createDataFrame([(1, "a", 0.5)], "student_id int, concept string, mastery double")
    got = {x["dst"]: x["reward"] for x in planning.edge_reward(edges, nodes, mastery).collect()}
    assert abs(got["b"] - 0.96) < 1e-9 and got["z"] == -1


def test_example_adjustment(spark):
    requests = spark.createDataFrame([(1, "c"), (2, "c")], "student_id long, concept string")
    examples = spark.createDataFrame([("c", "e", 0.9)], "concept string, name string, relevance double")
    moods = spark.createDataFrame([(1, 0.7), (2, 0.5)], "student_id long, joy double")
    got = {x["student_id"]: x["adjusted"] for x in r.recommend_examples(requests, examples, moods).collect()}
    assert got == {1: 1.026, 2: 0.855}


def test_paths(spark, small):
    nodes, edges = small
    pairs = spark.createDataFrame([("limit", "integral"), ("variable", "recursion"), ("integral", "limit"), ("loop", "loop")], "start string, target string")
    got = {}
    for x in g.shortest_learning_path(edges, pairs).orderBy("step").collect():
        got.setdefault((x["start"], x["target"]), []).append((x["src"], x["dst"]))
    assert got == {("limit", "integral"): [("limit", "derivative"), ("derivative", "integral")], ("variable", "recursion"): [("variable", "loop"), ("loop", "recursion")]}


def test_values_match_value_iteration(spark, small):
    nodes, edges = small
    goals = spark.createDataFrame([(1, 1, "limit", "integral")], "goal_id long, student_id long, start string, target string")
    mastery = spark.createDataFrame([(1, "limit", 0.9)], "student_id long, concept string, mastery double")
    values = planning.learn_q_values(goals, edges, nodes, mastery)
    got = {(x["src"], x["dst"]): x["q"] for x in values.collect()}
    last = 0.4 * (1 - abs(0.8 - 0.2)) + 0.3 + 0.3
    first = 0.4 * (1 - abs(0.8 - 0.9)) + 0.3 + 0.3
    assert abs(got["derivative", "integral"] - last) < 1e-6 and abs(got["limit", "derivative"] - (first + 0.9 * last)) < 1e-6
    assert [x["name"] for x in planning.greedy_rollout(goals, planning.state_values(goals, edges, nodes, mastery)).orderBy("step").collect()] == ["limit", "derivative", "integral"]


def test_merges(spark, small):
    nodes, edges = small
    links = spark.createDataFrame([(1, "loop", "function", "INCLUDES", 0.4), (2, "loop", "function", "INCLUDES", 0.9), (3, "loop", "nowhere", "INCLUDES", 1.0), (4, "loop", None, "INCLUDES", 1.0)], "seq long, source string, target string, relation string, strength double")
    merged = g.merge_edges_concepts(edges, nodes, links)
    assert merged.count() == 7 and merged.where("dst = 'function'").first()["strength"] == 0.4
    best = rel.merge_relations_max(links.where("target is not null"))
    assert best.where("target = 'function'").first()["strength"] == 0.9


def test_responses(spark):
    rows = [
        ("b", 1, '```json\n[{"concept": "loop", "definition": "steps again", "importance": 5}]\n```'),
        ("b", 2, "Sure: [{'concept': 'set', 'definition': 'things', importance: 2,}] ok"),
        ("b", 3, '[{"concept": "概念名称", "definition": "x"}, {"concept": "y", "definition": ""}]'),
        ("b", 4, "数组是一组相同类型的数据。"),
        ("b", 5, None),
    ]
    got = {(x["page"], x["concept"]): x for x in ex.parse_point_responses(spark.createDataFrame(rows, "book_id string, page int, response string")).collect()}
    assert got[1, "Ioop"]["importance"] == 5 and got[1, "Ioop"]["difficulty"] == 3
    assert (2, "set") in got and not any(p == 3 for p, _ in got) and any(p == 4 for p, _ in got)


def test_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"0": "zero", "10": "ten"}')
    got = {(x["book_id"], x["page"], x["text"]) for x in src.read_page_texts(spark, str(tmp_path / "one.json")).collect()}
    assert got == {("one", 0, "zero"), ("one", 10, "ten")}
    (tmp_path / "graph.json").write_text('{"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "b", "type": "INCLUDES"}]}')
    nodes, links = src.read_graph_json(spark, str(tmp_path / "graph.json"))
    assert nodes.first()["name"] == "a" and nodes.first()["difficulty"] == 3 and links.first()["strength"] == 0.5
    (tmp_path / "math_concepts.txt").write_text("set\n\n map \n")
    assert {tuple(x) for x in src.read_vocabularies(spark, str(tmp_path / "math_concepts.txt")).collect()} == {("math", "set"), ("math", "map")}


def slow_path(steps, start, target, most):
    """The shortest path with the smallest parent at each level, from the target back."""
    depth, frontier = {start: 0}, [start]
    for d in range(1, most + 1):
        frontier = sorted({b for a, b in steps if a in frontier and b not in depth})
        depth |= dict.fromkeys(frontier, d)
    if target not in depth or start == target:
        return None
    path = [target]
    while path[-1] != start:
        path.append(min(a for a, b in steps if b == path[-1] and depth.get(a) == depth[path[-1]] - 1))
    return path[::-1]


@pytest.mark.parametrize("n,edges_of,most", [(12, 1.3, 5), (30, 1.6, 5), (20, 3, 2), (25, 1.1, 9)])
def test_shortest_paths_match_brute_force(spark, n, edges_of, most):
    rng = random.Random(n)
    steps = sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(int(n * edges_of))})
    edges = spark.createDataFrame([(a, b, t, 0.5) for a, b in steps for t in ("T", "A")], "src string, dst string, type string, strength double")
    pairs = sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(40)} | {("n00", "none"), ("none", "n01"), ("n02", "n02")})
    got = {}
    for r in sorted(g.shortest_learning_path(edges, spark.createDataFrame(pairs + [(None, "n01")], "start string, target string"), most).collect(), key=lambda r: r["step"]):
        got.setdefault((r["start"], r["target"]), []).append(r)
    want = {p: w for p in pairs if (w := slow_path(steps, *p, most))}
    assert got.keys() == want.keys() and want
    for pair, path in want.items():
        assert [(r["src"], r["dst"]) for r in got[pair]] == list(zip(path, path[1:])) and {r["type"] for r in got[pair]} == {"A"}
