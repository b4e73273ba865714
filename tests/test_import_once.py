import pytest

from learnloom.queries import bindings, files
from learnloom.sources.tables import MOST_PARTS, Tables
from learnloom.streaming import settings

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["import_stored_graph", "import_stored_labelled_edges"])
def test_relations_are_made_once(monkeypatch, spark, name):
    made, own = [], bindings.raw_relations
    monkeypatch.setattr(bindings, "raw_relations", lambda *a: made.append(a) or own(*a))
    assert getattr(files, name)(spark, SF).count() and len(made) == 1


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    rows = spark.range(200_000).selectExpr("id", "sha2(string(id), 256) AS text").repartition(4)
    with settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}):
        tables.replace("t", rows, ["id"], 2)
    assert len(list((tmp_path / "t" / "t").glob("*/_bucket=0/*.parquet"))) > 1
    assert tables.read("t").distinct().count() == 200_000


def test_full_buckets_are_written_anew_with_what_comes_in(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    tables.replace("t", spark.createDataFrame([(0, "first")], "id long, text string"), ["id"], 1)
    for k in range(1, MOST_PARTS + 2):
        rows = spark.createDataFrame([(k, "new"), (0, "late"), (k - 1, "late")], "id long, text string")
        assert tables.insert_absent("t", rows) == 1 and tables.insert_absent("t", rows) == 0
    assert len(tables.log.last()[1]["tables"]["t"]["parts"]["0"]) <= MOST_PARTS
    assert sorted(map(tuple, tables.read("t").collect())) == [(0, "first")] + [(k, "new") for k in range(1, MOST_PARTS + 2)]
