import json

import pytest

from learnloom.operators import messages as m


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([("Concept", n, "s", d, 3, f"about {n}") for n, d in (("a", 1), ("b", 2), ("c", 5))], "label string, name string, subject string, difficulty int, importance int, description string")
    edges = spark.createDataFrame([("a", "b", "INCLUDES", 0.9), ("a", "c", "INCLUDES", 0.4), ("b", "c", "INCLUDES", None)], "src string, dst string, type string, strength double")
    details = spark.createDataFrame([("a", "x1", 0.9, 0.1), ("a", "x2", 0.8, 0.7)], "concept string, name string, relevance double, frequency double")
    return nodes, edges, details


def test_each_command_has_its_answer(spark, graph):
    nodes, edges, _ = graph
    rows = [
        ("1", json.dumps({"command": "init_session"})), ("2", json.dumps({"command": "end_session", "params": {"session_id": "s9"}})),
        ("3", json.dumps({"command": "query_knowledge", "params": {"concept": "b"}})), ("4", json.dumps({"command": "query_knowledge", "params": {"concept": "q"}})),
        ("5", json.dumps({"command": "recommend_knowledge", "params": {"concept": "a", "student_id": 7}})), ("6", json.dumps({"command": "recommend_knowledge", "params": {"concept": "c", "student_id": 7}})),
        ("7", json.dumps({"command": "fly"})), ("8", "{}"),
    ]
    mastery = spark.createDataFrame([(7, "b", 1.0)], "student_id long, concept string, mastery double")
    got = {r["id"]: r for r in m.process_commands(spark.createDataFrame(rows, "id string, data string"), nodes, edges, mastery).collect()}
    assert len(got) == 8 and got["1"]["session_id"] == "session_1" and got["2"]["session_id"] == "s9"
    assert (got["3"]["definition"], got["3"]["difficulty"], got["3"]["error"]) == ("about b", 2, None)
    assert got["4"]["error"] == "unknown concept: q" and got["4"]["definition"] is None
    assert got["5"]["recommendations"] == ["c", "b"] or got["5"]["recommendations"] == ["b", "c"]
    assert got["6"]["recommendations"] == [] and got["7"]["error"] == "unknown command: fly" and got["8"]["error"] == "unknown command: "


def test_turns_are_answered_by_intent_and_mood(spark, graph):
    nodes, edges, details = graph
    steps = [("concept_explanation", ["what"]), ("example_request", ["example"]), ("misconception_query", ["wrong"]), ("related_concepts", ["near"])]
    asked = [(1, 1, "what is it", "a"), (1, 2, "an example", "a"), (2, 1, "example please", "a"), (1, 3, "what is wrong", "q"), (1, 4, "goes wrong", "a"), (1, 5, "near it", "a"), (1, 6, "hello", "a")]
    queries = spark.createDataFrame(asked, "session_id long, seq long, content string, concept string")
    moods = spark.createDataFrame([(1, 1, "joy", 0.9, 0.9), (1, 2, "sadness", 0.1, 0.2)], "session_id long, at long, emotion string, attention double, understanding double")
    got = {(r["session_id"], r["seq"]): r for r in m.teaching_turns(queries, nodes, edges, details, details, moods, steps).collect()}
    assert len(got) == 7
    assert got[1, 1]["answer"] == ["about a"] and got[1, 1]["emotion"] == "sadness" and got[1, 1]["strategy"]["tone"] == "encouraging"
    assert got[1, 2]["answer"] == ["x1", "x2"] and got[2, 1]["answer"] == ["x1"] and got[2, 1]["strategy"]["tone"] == "neutral"
    assert got[1, 3]["answer"] == [] and got[1, 4]["answer"] == ["x2"] and got[1, 5]["answer"] == ["b", "c"] and got[1, 6]["answer"] == []
