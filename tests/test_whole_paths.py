import random

from learnloom.queries import bindings, recommend


def depths(step, start):
    """Plain breadth-first search: the least number of moves to each name."""
    found, level = {start: 0}, [start]
    while level:
        level = [y for x in level for y in sorted(step.get(x, ())) if y not in found and not found.update({y: found[x] + 1})]
    return found


def test_starts_and_paths_match_brute_force_up_to_five_moves(spark, monkeypatch):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(24)]
    pairs = sorted({(names[i], names[i + 1]) for i in range(23)} | {tuple(rng.sample(names, 2)) for _ in range(12)})
    known = [(s, n, round(rng.random(), 3)) for s in range(1, 31) for n in rng.sample(names, 3)]
    asked = [(s, names[0], rng.choice(names)) for s in range(1, 31)]
    tables = {
        "edges": spark.createDataFrame([("Concept", a, "Concept", b, "INCLUDES", 0.5) for a, b in pairs], "src_label string, src string, dst_label string, dst string, type string, strength double"),
        "nodes": spark.createDataFrame([("Concept", n, "s", 1, 1, n) for n in names], "label string, name string, subject string, difficulty int, importance int, description string"),
        "mastery": spark.createDataFrame(known, "student_id long, concept string, mastery double"),
        "requests": spark.createDataFrame(asked, "student_id long, concept string, target string"),
    }
    for name, df in tables.items():
        monkeypatch.setattr(bindings, name, lambda *_, df=df: df)
    step = {}
    for a, b in pairs:
        step.setdefault(a, set()).add(b)
    far = {n: depths(step, n) for n in names}
    start, long = {}, {}
    for s, _, target in asked:
        own = sorted((-m, n) for x, n, m in known if x == s)
        led = [x for x in own if -x[0] > 0.7 and 0 < far[x[1]].get(target, 9) <= 5]
        start[s] = (led or own)[0][1]
        d = far[start[s]].get(target, 9)
        long[s] = d if 0 < d <= 5 else None
    assert any(d and d > 2 for d in long.values())
    assert {r["student_id"]: r["start"] for r in recommend.choose_start_concept(spark, "").collect()} == start
    paths = {}
    for r in recommend.recommend_learning_path(spark, "").where("kind = 'path'").collect():
        paths.setdefault(r["student_id"], {})[r["step"]] = r["name"]
    assert {s: len(p) for s, p in paths.items()} == {s: d for s, d in long.items() if d}
    for s, _, target in asked:
        if long[s]:
            walk = [start[s], *(paths[s][k] for k in range(1, long[s] + 1))]
            assert walk[-1] == target and all(b in step[a] for a, b in zip(walk, walk[1:]))


def test_no_table_of_a_search_has_a_row_for_each_name_that_it_meets(spark, monkeypatch):
    """Forty students on a ring with chords: a search from each target meets some thirty names in five moves."""
    from learnloom.operators import graph, recommend as r

    names, rows, keep = [f"n{i:02}" for i in range(40)], [], graph.stored

    def counted(df):
        rows.append((out := keep(df)).count())
        return out

    for module in (graph, r):
        monkeypatch.setattr(module, "stored", counted)
    edges = spark.createDataFrame([(names[i], names[(i + k) % 40], "INCLUDES", 0.5) for i in range(40) for k in (1, 7)], "src string, dst string, type string, strength double")
    requests = spark.createDataFrame([(i, names[i]) for i in range(40)], "student_id long, target string")
    mastery = spark.createDataFrame([(i, names[(i + 32) % 40], 0.9) for i in range(40)], "student_id long, concept string, mastery double")
    assert {x["student_id"]: x["start"] for x in r.choose_start_concept(requests, edges, mastery).collect()} == {i: names[(i + 32) % 40] for i in range(40)}
    assert max(rows) <= 80


def test_paths_are_not_searched_again_and_edges_and_mastery_are_made_once(spark, monkeypatch):
    from learnloom.operators import graph, recommend as r

    made, asked, own = [], [], graph.meeting_levels
    for name in ("edges", "mastery"):
        monkeypatch.setattr(bindings, name, lambda *a, name=name, f=getattr(bindings, name): made.append(name) or f(*a))

    def seen(g, pairs, depth):
        asked.extend((x["start"], x["target"]) for x in pairs.collect())
        return own(g, pairs, depth)

    for module in (graph, r):
        monkeypatch.setattr(module, "meeting_levels", seen)
    assert recommend.learning_sequence(spark, "/root/testdata/sf0.001").count()
    assert sorted(made) == ["edges", "mastery"] and len(asked) == len(set(asked))


def test_levels_of_pairs_that_have_met_are_not_stored(spark, monkeypatch):
    """Forty pairs three moves apart on a ring with chords: the last level, which joins them, is never written."""
    from learnloom.operators import graph as g

    names, arrays, keep = [f"n{i:02}" for i in range(40)], [], g.stored

    def noted(df):
        out = keep(df)
        if out.columns[1:] == ["names"]:
            arrays.append(max((len(x["names"]) for x in out.collect()), default=0))
        return out

    edges = spark.createDataFrame([(names[i], names[(i + k) % 40], "INCLUDES", 0.5) for i in range(40) for k in (1, 7, 11)], "src string, dst string, type string, strength double")
    pairs = spark.createDataFrame([(names[i], names[(i + 9) % 40]) for i in range(40)], "start string, target string")
    monkeypatch.setattr(g, "stored", noted)
    rows = g.shortest_learning_path(edges, pairs).collect()
    assert len(rows) == 120 and max(arrays) == 3


def test_searches_in_slices_find_the_same(spark, monkeypatch):
    from learnloom.operators import graph as g

    rng = random.Random(11)
    names = [f"n{i:02}" for i in range(30)]
    edges = spark.createDataFrame(sorted({(*rng.sample(names, 2), "INCLUDES", 0.5) for _ in range(60)}), "src string, dst string, type string, strength double")
    pairs = spark.createDataFrame([tuple(rng.sample(names, 2)) for _ in range(40)], "start string, target string")
    whole = sorted(map(tuple, g.shortest_learning_path(edges, pairs).collect()))
    monkeypatch.setattr(g, "SLICE_NUMBERS", 20)
    assert sorted(map(tuple, g.shortest_learning_path(edges, pairs).collect())) == whole and whole
