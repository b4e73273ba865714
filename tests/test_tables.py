"""Tables that change by commits, and streams that fill several of them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from learnloom.operators import messages as m
from learnloom.sources.tables import BatchSink, CommitConflict, Log, Tables

NODES = "label string, name string, description string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_table_is_replaced_by_one_that_reads_it(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    tables.replace("numbers", spark.range(5))
    tables.replace("numbers", tables.read("numbers").selectExpr("id * 2 AS id"))
    assert rows_of(tables.read("numbers")) == [(0,), (2,), (4,), (6,), (8,)]
    assert rows_of(tables.read("numbers", 0)) == [(i,) for i in range(5)]
    tables.replace("numbers", spark.range(0))
    assert rows_of(tables.read("numbers")) == []
    tables.vacuum(1)
    assert tables.log.versions() == [2] and os.listdir(tmp_path / "t" / "numbers") == []


def test_a_write_that_fails_leaves_the_old_tables(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    tables.replace_all({"a": spark.range(3), "b": spark.range(4)})
    broken = spark.range(100).repartition(4).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        tables.replace_all({"a": spark.range(9), "b": broken})
    assert tables.read("a").count() == 3 and tables.read("b").count() == 4
    tables.vacuum()
    assert all(len(os.listdir(tmp_path / "t" / n)) == 1 for n in "ab")


def test_the_first_of_two_writers_commits(spark, tmp_path):
    one, two = Log(spark, str(tmp_path / "t")), Log(spark, str(tmp_path / "t"))
    at, _ = one.last()
    one.commit(at + 1, {"n": 1})
    with pytest.raises(CommitConflict):
        two.commit(at + 1, {"n": 2})
    assert two.last() == (0, {"n": 1}) and [f for f in os.listdir(tmp_path / "t" / "_log") if not f.endswith("crc")] == [f"{0:020d}.json"]


def test_imports_touch_only_the_buckets_of_their_keys(spark, tmp_path):
    rng = random.Random(1)
    path = tmp_path / "t"
    tables = Tables(spark, str(path))
    old = [("Concept", f"n{i}", "old") for i in range(200)]
    tables.replace("nodes", spark.createDataFrame(old, NODES), ["label", "name"], 16)
    want = {r[:2]: r for r in old}
    for k in range(12):  # more imports than a bucket has folders
        new = [("Concept", f"n{rng.randrange(400)}", f"import {k}") for _ in range(6)] + [("Example", f"n{k}", "same name"), ("Concept", None, f"null {k}")]
        before = tables.log.last()[1]["tables"]["nodes"]["parts"]
        first = {r[:2]: r for r in reversed(new)}
        added = tables.insert_absent("nodes", spark.createDataFrame(list(first.values()), NODES))
        absent = {key: r for key, r in first.items() if key not in want}
        assert added == len(absent)
        want |= absent
        after = tables.log.last()[1]["tables"]["nodes"]["parts"]
        assert sum(before[b] != after[b] for b in after if b in before) <= len(absent) and max(map(len, after.values())) <= 9
    assert rows_of(tables.read("nodes")) == sorted(want.values(), key=str)
    assert any(len(p) == 1 for p in after.values()) and tables.insert_absent("nodes", spark.createDataFrame(old[:5], NODES)) == 0
    asked = spark.createDataFrame([("Concept", "n5"), ("Concept", None), ("Example", "n3"), ("Example", "none")], "label string, name string")
    found = tables.lookup("nodes", asked)
    assert {r[:2] for r in rows_of(found)} == {("Concept", "n5"), ("Concept", None), ("Example", "n3")}
    assert {f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles()} < {str(b) for b in range(16)}


MESSAGES = "session_id long, seq long, value string"


def messages(spark):
    raw = [
        '{"type": "audio", "id": "a", "data": {"data": "aGVsbG8=", "sample_rate": 8000}}', '{"type": "audio", "id": "b", "data": {"data": "***"}}',
        '{"type": "image", "id": "c", "data": {"data": "aGk=", "format": "raw"}}', '{"type": "image", "id": "d", "data": {"data": "aGk=", "format": "raw", "shape": [1, 2]}}',
        '{"type": "text", "id": "e", "data": {"text": "what is it?", "context": {"page": 3}}}', '{"type": "command", "id": "f", "data": {"command": "end_session", "params": {"session_id": "s1"}}}',
        '{"type": "command", "id": "g", "data": {"command": "dance"}}', '{"type": "dance", "id": "h", "data": {}}', "{broken", None,
    ]
    return spark.createDataFrame([(i % 3, i, v) for i, v in enumerate(raw)], MESSAGES)


def test_messages_have_a_table_for_each_kind(spark):
    tables = {n: {r["seq"]: r.asDict() for r in df.collect()} for n, df in m.typed_messages(messages(spark)).items()}
    assert {n: sorted(t) for n, t in tables.items()} == {"audio": [0, 1], "image": [2, 3], "text": [4], "command": [5, 6], "error": [7, 8, 9]}
    assert (tables["audio"][0]["bytes"], tables["audio"][0]["size"], tables["audio"][0]["sample_rate"], tables["audio"][0]["format"]) == (b"hello", 5, 8000, "wav")
    assert tables["audio"][1]["error"] == "not base64" and tables["audio"][0]["error"] is None
    assert (tables["image"][2]["error"], tables["image"][3]["error"], tables["image"][3]["shape"]) == ("no shape", None, [1, 2])
    assert (tables["text"][4]["text"], tables["text"][4]["context"]) == ("what is it?", '{"page":3}')
    assert (tables["command"][5]["asked_session_id"], tables["command"][6]["error"]) == ("s1", "unknown command: dance")
    assert {i: (r["id"], r["error"]) for i, r in tables["error"].items()} == {7: ("h", "unsupported type: dance"), 8: ("", "invalid JSON"), 9: ("", "invalid JSON")}


def landed(spark, folder, rows):
    rows.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_batch_that_fails_midway_is_written_once(spark, tmp_path):
    failing = {"once": True}

    def split(batch):
        found = m.typed_messages(batch)
        if failing.pop("once", False):  # after two of the five tables
            found["text"] = found["text"].withColumn("text", F.raise_error(F.lit("executor lost")))
        return found

    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    every = messages(spark)
    stream = landed(spark, folder, every.where("seq < 6"))
    sink = BatchSink(spark, path, split)
    with pytest.raises(Exception, match="executor lost"):
        sink.drain(stream, state, partitions=2)
    assert os.path.isdir(f"{path}/audio") and sink.log.last() == (-1, {})
    for _ in range(2):  # a second run has nothing to do
        sink.drain(stream, state, partitions=2)
    sink.drain(landed(spark, folder, every.where("seq >= 6")), state, partitions=2)
    want = m.typed_messages(every)
    for name, df in want.items():
        got = sink.read(name)
        assert rows_of(got.select(*df.columns)) == rows_of(df), name
    assert sink.log.last()[1]["done"] == {"stream": 1}
    sink(every, 1)  # a batch that comes again changes nothing
    assert rows_of(sink.read("text").select(*want["text"].columns)) == rows_of(want["text"])
    other = BatchSink(spark, path, m.typed_messages, "second")
    other(every, 0)
    assert sink.read("error").groupBy("_writer").count().count() == 2 and sink.read("error").count() == 6


def test_commands_see_the_graph_of_their_batch(spark, tmp_path):
    from learnloom import streaming as st

    nodes = "label string, name string, subject string, difficulty int, importance int, description string"
    tables = Tables(spark, str(tmp_path / "graph"))
    graph = {
        "nodes": spark.createDataFrame([("Concept", n, "s", 3, 3, f"about {n}") for n in "abcd"], nodes),
        "edges": spark.createDataFrame([("a", "b", "INCLUDES", 0.5)], "src string, dst string, type string, strength double"),
        "mastery": spark.createDataFrame([(1, "a", 0.9)], "student_id long, concept string, mastery double"),
    }
    tables.replace_all(graph, {"nodes": (["label", "name"], 4), "edges": (["src", "dst", "type"], 4)})
    recommend = '{"command": "recommend_knowledge", "params": {"student_id": 1, "concept": "a"}}'
    asked = lambda i: [(f"m{i}", recommend), (f"q{i}", '{"command": "query_knowledge", "params": {"concept": "e"}}')]
    sink = BatchSink(spark, str(tmp_path / "out"), st.command_answers(tables))
    folder, kind = str(tmp_path / "in"), "id string, data string"

    def run(i):
        spark.createDataFrame(asked(i), kind).coalesce(1).write.mode("append").parquet(folder)
        sink.drain(spark.readStream.schema(kind).parquet(folder), str(tmp_path / "state"))
        return {r["id"]: r for r in sink.read("answers").collect()}

    first = run(1)
    assert first["m1"]["recommendations"] == ["b"] and first["q1"]["error"] == "unknown concept: e"
    tables.insert_absent("edges", spark.createDataFrame([("a", "c", "INCLUDES", 0.9), ("a", "b", "INCLUDES", 1.0)], "src string, dst string, type string, strength double"))
    tables.insert_absent("nodes", spark.createDataFrame([("Concept", "e", "s", 3, 3, "new")], nodes))
    second = run(2)
    assert second["m2"]["recommendations"] == ["c", "b"] and second["q2"]["definition"] == "new" and second["m1"] == first["m1"]
    batch = m.process_commands(spark.createDataFrame(asked(2), kind), *(tables.read(n) for n in ("nodes", "edges", "mastery")))
    assert rows_of(batch) == rows_of(sink.read("answers").where("_batch = 1").select(*batch.columns))
