"""Files that are written by others, in every layout that the readers take."""

import json
import random

import pytest

from learnloom import sources as src
from learnloom.operators import graph as g
from learnloom.sources.tables import Tables

ODD = ["plain", 'with "quotes", "and" more', "back\\slash\\", "},\n{ line", 'a\n"12": "x",', '{"}', "", "指针，", '", "', "}", '"}', "{", "],"]


@pytest.fixture
def small_splits(spark):
    """Files are cut into ranges of few bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent,separator", [(2, None), (None, None), (None, '", "')])
def test_page_texts_are_read_by_ranges(spark, tmp_path, small_splits, indent, separator):
    rng = random.Random(1)
    books = {name: {str(i): rng.choice(ODD) + str(i) + rng.choice(ODD) for i in range(200)} for name in ("one", "b two")}
    for name, pages in books.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(pages, ensure_ascii=False, indent=indent), encoding="utf-8")
    df = src.read_page_texts(spark, str(tmp_path), separator)
    assert df.rdd.getNumPartitions() > 6
    got = df.collect()
    assert len(got) == 400
    for name, pages in books.items():
        assert {str(r["page"]): r["text"] for r in got if r["book_id"] == name} == pages


def test_page_files_of_books_without_a_name(spark, tmp_path):
    rows = [("a b", 1, "x\ny"), (None, 2, 'quo"te'), ("c/d", 3, ""), ("a b", 4, "}")]
    src.write_page_files(spark.createDataFrame(rows, "book_id string, page int, text string"), str(tmp_path / "p"))
    assert sorted(map(tuple, src.read_page_texts(spark, str(tmp_path / "p")).collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("indent", [2, 4])
def test_graphs_are_read_by_ranges(spark, tmp_path, small_splits, indent):
    rng = random.Random(indent)
    nodes = [{"id": f"n{i}", "name": rng.choice(ODD), "definition": rng.choice(ODD) * 3, "importance": i % 5} for i in range(150)]
    links = [{"source": f"n{i}", "target": rng.choice(ODD), "type": "T", "strength": i / 7} for i in range(150)]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": nodes, "links": links}, ensure_ascii=False, indent=indent), encoding="utf-8")
    split, whole = src.read_graph_lines(spark, str(tmp_path)), src.read_graph_json(spark, str(tmp_path))
    assert split[0].rdd.getNumPartitions() > 5
    for a, b in zip(split, whole):
        plain = lambda df: [str(tuple(r)) for r in df.orderBy("seq").drop("seq").collect()]
        assert plain(a) == plain(b) and a.select("seq").distinct().count() == 150


def test_an_import_gives_what_a_merge_gives(spark, tmp_path):
    nodes = spark.createDataFrame([("Concept", "a", "s", 1, 1, "old"), ("Example", "b", "s", 1, 1, "old")], "label string, name string, subject string, difficulty int, importance int, description string")
    edges = spark.createDataFrame([("a", "a", "T", 0.1)], "src string, dst string, type string, strength double")
    new = [(1, "x", "a", "Concept", "new"), (2, "x", "b", "Concept", "first"), (3, "x", "b", "Concept", "second"), (4, "c", None, "Concept", "id only"), (5, "x", "d", "Example", "other"), (6, None, "", "Concept", "none")]
    incoming = spark.createDataFrame(new, "seq long, id string, name string, type string, definition string").selectExpr("*", "CAST(NULL AS INT) AS difficulty", "2 AS importance")
    links = spark.createDataFrame([(1, "a", "b", "T", 0.2), (2, "a", "b", "T", 0.9), (3, "a", "a", "T", 0.9), (4, "a", "zz", "T", 0.5), (5, "b", "a", None, None)], "seq long, source string, target string, relation string, strength double")
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    tables = Tables(spark, str(tmp_path / "one"))
    tables.replace_all({"nodes": nodes, "edges": edges}, {"nodes": (["label", "name"], 4), "edges": (["src", "dst", "type"], 4)})
    added = src.import_graph(tables, incoming, links)
    merged = g.merge_nodes_insert_only(nodes, incoming)
    assert rows(tables.read("nodes"), *merged.columns) == rows(merged, *merged.columns)
    want = g.merge_edges_concepts(edges, merged, links)
    assert rows(tables.read("edges"), *want.columns) == rows(want, *want.columns)
    assert added == {"nodes": 1, "edges": 1} and src.import_graph(tables, incoming, links) == {"nodes": 0, "edges": 0}
    tables = Tables(spark, str(tmp_path / "two"))  # nothing is there yet
    added = src.import_graph(tables, incoming, links, typed=True)
    none = nodes.where("false")
    merged = g.merge_nodes_typed(none, incoming)
    assert rows(tables.read("nodes"), *merged.columns) == rows(merged, *merged.columns)
    want = g.merge_edges_any_label(tables.read("edges").where("false"), merged, links)
    assert rows(tables.read("edges"), *want.columns) == rows(want, *want.columns) and added["edges"] == want.count() > 0


def test_snapshots_vocabularies_and_structures_come_back(spark, tmp_path):
    words = spark.createDataFrame([("d1", "stack"), ("d1", " heap "), ("d 2", "指针"), ("d1", "")], "domain string, term string")
    src.write_vocabularies(words, str(tmp_path / "v"))
    assert sorted(map(tuple, src.read_vocabularies(spark, str(tmp_path / "v")).collect())) == [("d 2", "指针"), ("d1", "heap"), ("d1", "stack")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "physics_concepts.txt").write_text("force\n\nmass\n")
    assert sorted(map(tuple, src.read_vocabularies(spark, str(tmp_path / "f")).collect())) == [("physics", "force"), ("physics", "mass")]
    chapters = spark.createDataFrame([("b", "1", "One", 0), (None, "2", "Two", 3)], "book_id string, chapter string, title string, page int")
    sections = spark.createDataFrame([("b", "1.1", "First", 1, "1"), ("only", "3.1", "S", 2, "3")], "book_id string, section string, title string, page int, chapter string")
    src.write_book_structure(chapters, sections, str(tmp_path / "s"))
    got = src.read_book_structure(spark, str(tmp_path / "s"))
    assert [sorted(map(tuple, d.collect()), key=str) for d in got] == [sorted(map(tuple, d.collect()), key=str) for d in (chapters, sections)]
    series = spark.createDataFrame([(1, [0.5, None])], "session_id long, joy array<double>")
    src.write_monitor_snapshot(series, series, series, str(tmp_path / "m"))
    assert [d.collect() for d in src.read_monitor_snapshot(spark, str(tmp_path / "m"), *[series.schema] * 3)] == [series.collect()] * 3
