import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from learnloom.plans import planning
from learnloom.queries import bindings, graph


@pytest.fixture
def cyclic(spark):
    """A ring with chords; the targets are more than two moves from the start, one is not in the graph."""
    names = "abcdefg"
    pairs = [(names[i], names[(i + 1) % 7]) for i in range(7)] + [("b", "a"), ("d", "b"), ("f", "c")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([("Concept", n, 1 + i % 5, 1 + (2 * i) % 5) for i, n in enumerate(names[:-1])], "label string, name string, difficulty int, importance int").withColumn("description", F.lit("d"))
    goals = spark.createDataFrame([(1, 1, "a", "e"), (2, 2, "a", "zz"), (3, 1, "nowhere", "a")], "goal_id long, student_id long, start string, target string")
    mastery = spark.createDataFrame([(1, "a", 0.9), (1, "c", 0.4)], "student_id long, concept string, mastery double")
    return pairs, goals, edges, nodes, mastery


def plain_values(pairs, known, of, moves_from, gamma=0.9):
    """Plain value iteration."""
    def reward(s, d):
        if d not in of:
            return -1
        match = 1 - abs(of[d]["difficulty"] / 5 - min(known.get(s, 0) + 0.2, 0.9))
        return 0.4 * match + 0.3 * of[d]["importance"] / 5 + 0.3 * (1 - known.get(d, 0))

    moves, want = [p for p in pairs if p[0] in moves_from], {}
    for _ in range(500):
        want = {(s, d): reward(s, d) + gamma * max((q for (x, _), q in want.items() if x == d), default=0) for s, d in moves}
    return want


@pytest.mark.parametrize("most", [100, 0])
def test_values_match_plain_value_iteration(cyclic, most):
    pairs, goals, *tables = cyclic
    got = {}
    for r in planning.learn_q_values(goals, *tables, 0.4, graph_edges=most).collect():
        got.setdefault(r["goal_id"], {})[r["src"], r["dst"]] = r["q"]
    of = {r["name"]: r for r in tables[1].collect()}
    assert set(got) == {1, 2}
    for goal, known, states in ((1, {"a": 0.9, "c": 0.4}, "abcd"), (2, {}, "abcdefg")):
        want = plain_values(pairs, known, of, states, 0.4)
        assert got[goal].keys() == want.keys() and all(abs(got[goal][k] - want[k]) < 1e-4 for k in want)


def test_both_ways_choose_the_same_moves(cyclic):
    one, two = (
        sorted((r["goal_id"], r["src"], r["next"], round(r["value"], 4)) for r in planning.state_values(*cyclic[1:], 0.4, graph_edges=most).collect()) for most in (100, 0)
    )
    assert one == two and len(one) == 11
    path = planning.greedy_rollout(cyclic[1], planning.state_values(*cyclic[1:], 0.4)).where("goal_id = 1").orderBy("step").collect()
    best = {s: n for g, s, n, _ in one if g == 1}
    assert path[0]["name"] == "a" and all(best[x["name"]] == y["name"] for x, y in zip(path, path[1:]))


@pytest.mark.parametrize("most", [100, 0])
def test_unsettled_values_are_an_error(cyclic, most):
    with pytest.raises(Exception, match="did not settle"):
        planning.state_values(*cyclic[1:], rounds=1, graph_edges=most).collect()


def test_registered_queries_use_the_whole_depth(monkeypatch, spark, cyclic):
    pairs, goals, *tables = cyclic
    for name, df in zip(("edges", "nodes", "mastery"), tables):
        monkeypatch.setattr(bindings, name, lambda *_, df=df: df)
    monkeypatch.setattr(graph, "_goals", lambda *_: goals)
    got = {(r["goal_id"], r["dst"]): r["q"] for r in graph.learn_q_values(spark, "").collect()}
    want = plain_values(pairs, {"a": 0.9, "c": 0.4}, {r["name"]: r for r in tables[1].collect()}, "abcd")
    assert set(got) == {(1, "b"), (2, "b")} and abs(got[1, "b"] - want["a", "b"]) < 1e-3
    paths = {}
    for r in sorted(graph.greedy_rollout(spark, "").collect(), key=lambda r: (r["goal_id"], r["step"])):
        paths.setdefault(r["goal_id"], []).append(r)
    of = {r["name"]: r for r in tables[1].collect()}
    for goal, known, target, states in ((1, {"a": 0.9, "c": 0.4}, "e", "abcd"), (2, {}, "zz", "abcdefg")):
        values, path = plain_values(pairs, known, of, states), ["a"]
        while path[-1] != target and len(path) < 11:
            path.append(max((q, -ord(d)) for (s, d), q in values.items() if s == path[-1])[1])
            path[-1] = chr(-path[-1])
        assert [r["name"] for r in paths[goal]] == (path if path[-1] == target else path[:10])
        for r in paths[goal]:
            n = of.get(r["name"])
            assert (r["difficulty"], r["importance"], r["mastery"]) == ((n["difficulty"], n["importance"], known.get(r["name"], 0.0)) if n else (None,) * 3)
    assert [r["name"] for r in paths[3]] == ["nowhere"]


@pytest.mark.parametrize("most", [100, 0])
def test_equal_moves_go_to_the_first_name(spark, most):
    """Two ways of the same worth, whose sums are rounded in different orders."""
    edges = spark.createDataFrame([("s", "b"), ("s", "a"), ("a", "x"), ("b", "y"), ("x", "s"), ("y", "s")], "src string, dst string")
    nodes = spark.createDataFrame([("Concept", n, 3, 3, "text") for n in "sabxy"], "label string, name string, difficulty int, importance int, description string")
    goals = spark.createDataFrame([(1, 1, "s", "none")], "goal_id long, student_id long, start string, target string")
    mastery = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.1)], "student_id long, concept string, mastery double")
    got = planning.planned_paths(goals, edges, nodes, mastery, 0.5, 4, graph_edges=most).orderBy("step").collect()
    assert [r["name"] for r in got] == ["s", "a", "x", "s"]
    assert [(r["mastery"], r["description"]) for r in got] == [(0.0, "text"), (0.1, "text"), (0.0, "text"), (0.0, "text")]


def test_values_from_the_shared_base_are_those_of_a_full_solve():
    """Random graphs, goals that do and don't meet in time all they can ever meet."""
    rng, both = np.random.default_rng(5), set()
    for n, out, steps in ((60, 3, 10), (60, 1, 4), (200, 4, 3), (300, 6, 10)):
        pairs = np.unique(rng.integers(0, n, (n * out, 2)), axis=0)
        some = np.flatnonzero(rng.random(n) < 0.9)
        moves = pa.table({"src": pairs[:, 0].astype(np.int32), "dst": pairs[:, 1].astype(np.int32)})
        concepts = pa.table({"id": some.astype(np.int32), "difficulty": rng.integers(1, 6, len(some)) * 1.0, "importance": rng.integers(1, 6, len(some)) * 1.0})
        limits = {"gamma": 0.9, "max_steps": steps, "rounds": 400, "delta": planning.TIE / 100}
        fast, full = planning._Graph(n, moves, concepts).with_base(0.9, 400, limits["delta"]), planning._Graph(n, moves, concepts)
        starts, targets = rng.integers(0, n, 64), rng.integers(-1, n, 64)
        closed = fast.closed(starts, targets, steps)
        both |= set(closed.tolist())
        for start, target, ends in zip(starts.tolist(), targets.tolist(), closed.tolist()):
            own = rng.choice(n, 5, replace=False)
            levels = rng.random(5)
            with fast.goal(start, target, own, levels, ends, **limits), full.goal(start, target, own, levels, False, **limits):
                states = full.met(start, target, steps)
                assert np.abs(fast.value[states] - full.value[states]).max(initial=0) < 1e-7
                assert fast.followed(start, target, 0.9, steps) == full.followed(start, target, 0.9, steps)
                if ends:  # one move more would meet nothing
                    assert np.array_equal(states, full.met(start, target, steps + 1))
            assert np.array_equal(fast.value, fast.base) and not fast.level.any()
    assert both == {True, False}


def test_values_of_the_starts_do_not_store_those_of_all_states(monkeypatch, cyclic):
    def refused(*_, **__):
        raise AssertionError("the values of all states of all goals were asked for")

    every = {(r["goal_id"], r["src"], r["dst"]): r["q"] for r in planning.learn_q_values(*cyclic[1:], 0.4).collect()}
    monkeypatch.setattr(planning, "state_values", refused)
    got = {(r["goal_id"], r["src"], r["dst"]): r["q"] for r in planning.learn_q_values(*cyclic[1:], 0.4, starts_only=True).collect()}
    assert got.keys() == {k for k in every if k[1] == "a"} and all(abs(got[k] - every[k]) < 1e-7 for k in got)


def test_bounds_settle_to_the_values_that_are_asked_for():
    """Moves from the start and the path of best moves, where only what they rest on is settled, on random graphs."""
    rng, limits, fewer, rose = np.random.default_rng(8), {"gamma": 0.9, "max_steps": 10, "rounds": 400, "delta": planning.TIE / 100}, 0, 0
    for n, out in ((60, 3), (40, 2), (300, 6), (400, 5)):
        pairs = np.unique(rng.integers(0, n, (n * out, 2)), axis=0)
        pairs = pairs[pairs[:, 0] > n // 20]  # some states have no move
        some = np.flatnonzero(rng.random(n) < 0.9)
        moves = pa.table({"src": pairs[:, 0].astype(np.int32), "dst": pairs[:, 1].astype(np.int32)})
        concepts = pa.table({"id": some.astype(np.int32), "difficulty": rng.integers(1, 6, len(some)) * 1.0, "importance": rng.integers(1, 6, len(some)) * 1.0})
        lazy, full = (planning._Graph(n, moves, concepts).with_base(0.9, 400, limits["delta"]) for _ in range(2))
        busiest = np.argsort(np.bincount(lazy.to, minlength=n))[-5:]
        for k in range(64):
            start, target = int(rng.choice(pairs[:, 0])), int(rng.integers(-1, n))
            own = rng.choice(n, 5, replace=False) if k % 2 else np.unique(np.append(rng.choice(n, 3, replace=False), busiest))
            levels = rng.random(len(own))
            with lazy.goal(start, target, own, levels, True, **limits, whole=False), full.goal(start, target, own, levels, True, **limits):
                assert lazy.followed(start, target, 0.9, 10) == full.followed(start, target, 0.9, 10)
                (to, q), (_, want) = lazy.from_state(start, 0.9), full.from_state(start, 0.9)
                assert np.abs(q - want).max(initial=0) < 1e-7 and (lazy.value >= full.value - 1e-7).all()
                fewer += (lazy.value != lazy.base).sum() < (full.value != full.base).sum()
                rose += (full.value > full.base + 1e-6).any()
            for column in ("value", "worth", "asked", "low", "mine"):
                assert np.array_equal(getattr(lazy, column), getattr(full, column))
            assert np.array_equal(lazy.value, lazy.base) and not lazy.low.any() and not len(lazy.settled)
    assert fewer > 50 and rose > 5
