"""Tables in a shared folder that change by whole commits: replaced safely, or added to bucket by bucket.

A commit is a numbered file that says which folders make up each table; the highest number counts. Data folders are
written first and never changed; the commit file is written aside and renamed, which fails if another writer took the
number. So a job that fails, or is killed, leaves the old tables; a job may read what it replaces; and readers see all
tables of a commit or none. Folders that no kept commit names are removed by :meth:`Tables.vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import remove, stored

#: Folders of a bucket after which an import writes it anew as one.
MOST_PARTS = 8


class CommitConflict(RuntimeError):
    """Another writer committed first."""


class Log:
    """The numbered states of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{name}" if name else f"{self.path}/_log")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, system = self._place("")
        if not system.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in system.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def at(self, version: int) -> dict:
        place, system = self._place(f"{version:020d}.json")
        stream = system.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """The number of the last commit and its state; -1 and an empty one before the first."""
        versions = self.versions()
        return (versions[-1], self.at(versions[-1])) if versions else (-1, {})

    def commit(self, version: int, state: dict) -> None:
        """Makes ``state`` the commit ``version``, which must not be there yet."""
        aside, system = self._place(f".{uuid.uuid4().hex}")
        out = system.create(aside, False)
        try:
            out.write(json.dumps(state).encode())
        finally:
            out.close()
        place, _ = self._place(f"{version:020d}.json")
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(system.makeQualified(aside), system.makeQualified(place), none)
        except Exception as e:
            system.delete(aside, False)
            if "AlreadyExists" in str(e):
                raise CommitConflict(f"{self.path}: version {version} is there already") from e
            raise

    def forget(self, keep: int) -> None:
        """Removes all commits but the last ``keep``."""
        for version in self.versions()[:-keep]:
            place, system = self._place(f"{version:020d}.json")
            system.delete(place, False)


def _schema(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


def _of_key(key: list[str], alias: str = "") -> Column:
    """A key as a struct, so that null parts compare as equal."""
    return F.struct(*[F.col(f"{alias}{c}") for c in key])


class Tables:
    """Named tables below ``path``; see the module for how they change."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), Log(spark, path)

    def names(self) -> list[str]:
        return sorted(self.log.last()[1].get("tables", {}))

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as it is now, or was at a commit that is kept; of a bucketed one only some buckets, if asked."""
        state = self.log.last()[1] if version is None else self.log.at(version)
        table = state["tables"][name]
        wanted = table["parts"] if buckets is None else {str(b): table["parts"].get(str(b), []) for b in buckets}
        paths = [f"{self.path}/{folder}/_bucket={b}" for b, folders in wanted.items() for folder in folders]
        schema = _schema(table["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, name: str, df: DataFrame, key: list[str] | None = None, buckets: int = 1) -> None:
        """Makes ``df`` the table. With a key, rows are dealt to ``buckets`` by its hash. ``df`` may read the table."""
        self.replace_all({name: df}, {name: (key or [], buckets)})

    def replace_all(self, tables: dict[str, DataFrame], layout: dict[str, tuple[list[str], int]] | None = None) -> None:
        """Replaces several tables in one commit."""
        version, state = self.log.last()
        new = dict(state.get("tables", {}))
        for name, df in tables.items():
            key, n = (layout or {}).get(name, ([], 1))
            folder, found = self._write(name, df, key, n)
            new[name] = {"schema": df.schema.json(), "key": key, "buckets": n, "parts": {str(b): [folder] for b in found}}
        self.log.commit(version + 1, state | {"tables": new})

    def insert_absent(self, name: str, rows: DataFrame) -> int:
        """Adds the rows whose key the table does not have; of rows with one key any is taken, so give each key once.

        Only the buckets that the rows' keys fall in are read, their key columns alone, and only those that get rows
        change: they get one more folder, or are written anew as one after ``MOST_PARTS``. Returns the rows added.
        """
        version, state = self.log.last()
        table = state["tables"][name]
        key, n = table["key"], table["buckets"]
        columns = _schema(table["schema"]).names
        dealt = stored(rows.select(*columns).withColumn("_bucket", self._bucket(key, n)))
        touched = [r[0] for r in dealt.select("_bucket").distinct().collect()]  # at most ``n``
        old = self.read(name, version if version >= 0 else None, touched).select(_of_key(key).alias("_key"))
        new = dealt.withColumn("_key", _of_key(key)).join(old, "_key", "left_anti").dropDuplicates(["_key"]).drop("_key", "_bucket")
        schema = _schema(table["schema"])
        folder, found = self._write(name, new, key, n)
        paths = lambda buckets: [f"{self.path}/{folder}/_bucket={b}" for b in buckets]
        added = self.spark.read.schema(schema).parquet(*paths(found)).count() if found else 0
        remove(self.spark, dealt.stored_path)
        if not added:
            return 0
        parts = {b: list(folders) for b, folders in table["parts"].items()}
        full = [b for b in found if len(parts.get(str(b), [])) >= MOST_PARTS]
        for b in found:
            parts[str(b)] = [*parts.get(str(b), []), folder]
        if full:
            both = self.read(name, version, full).unionByName(self.spark.read.schema(schema).parquet(*paths(full)))
            whole = self._write(name, both, key, n)[0]
            parts |= {str(b): [whole] for b in full}
        tables = state["tables"] | {name: table | {"parts": parts}}
        self.log.commit(version + 1, state | {"tables": tables})
        return added

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets that the keys asked for fall in."""
        table = self.log.last()[1]["tables"][name]
        return [r[0] for r in keys.select(self._bucket(table["key"], table["buckets"])).distinct().collect()]  # at most their number

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of the keys asked for (the key's columns); only the buckets that they fall in are read."""
        key = self.log.last()[1]["tables"][name]["key"]
        asked = keys.select(*key).distinct()
        rows = self.read(name, buckets=self.touched(name, asked))
        return rows.join(asked, [rows[c].eqNullSafe(asked[c]) for c in key], "left_semi")

    def vacuum(self, keep: int = 2) -> None:
        """Removes commits but the last ``keep``, and the folders that none of these names."""
        self.log.forget(keep)
        used = {f for v in self.log.versions() for t in self.log.at(v).get("tables", {}).values() for fs in t["parts"].values() for f in fs}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for table in system.listStatus(root):
            if table.getPath().getName().startswith("_"):
                continue
            for folder in system.listStatus(table.getPath()):
                name = f"{table.getPath().getName()}/{folder.getPath().getName()}"
                if name not in used:
                    system.delete(folder.getPath(), True)

    @staticmethod
    def _bucket(key: list[str], n: int) -> Column:
        return (F.pmod(F.xxhash64(*key), F.lit(n)) if key else F.lit(0)).cast("int")

    def _write(self, name: str, df: DataFrame, key: list[str], n: int) -> tuple[str, list[int]]:
        """Writes a new folder, a folder below it for each bucket, with Bloom filters of the key's columns. Files are
        sorted by key; a large bucket is written by several tasks."""
        folder = f"{name}/{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self._bucket(key, n))
        if key:
            rows = rows.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *key)
        writer = rows.write.partitionBy("_bucket")
        for c in key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.path}/{folder}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        listed = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)
        return folder, sorted(int(s.getPath().getName().split("=")[1]) for s in listed if "=" in s.getPath().getName())


class BatchSink:
    """A ``foreachBatch`` target that fills several tables, each batch exactly once.

    ``split`` turns a batch into a table for each name. A batch's tables are written to folders named after the writer and
    the batch, over what an earlier attempt left there, and then become visible together by one commit. A batch that is
    committed is not written again. ``writer`` names the stream: a stream with a new checkpoint needs a new name.
    """

    def __init__(self, spark: SparkSession, path: str, split: Callable[[DataFrame], dict[str, DataFrame]], writer: str = "stream"):
        self.spark, self.path, self.split, self.writer = spark, path.rstrip("/"), split, writer
        self.log = Log(spark, path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.log.last()[1].get("done", {}).get(self.writer, -1) >= batch_id:
            return
        rows = batch.persist()
        try:
            schemas = {}
            for name, df in self.split(rows).items():
                df.write.mode("overwrite").parquet(f"{self.path}/{name}/_writer={self.writer}/_batch={batch_id}")
                schemas[name] = df.schema.json()
        finally:
            rows.unpersist()
        while True:  # other streams may commit to the same tables meanwhile
            version, state = self.log.last()
            done = state.get("done", {}) | {self.writer: batch_id}
            try:
                self.log.commit(version + 1, {"done": done, "schemas": state.get("schemas", {}) | schemas})
                break
            except CommitConflict:
                continue
        self.log.forget(4)

    def read(self, name: str) -> DataFrame:
        """What committed batches brought, with ``_writer`` and ``_batch``."""
        state = self.log.last()[1]
        if name not in state.get("schemas", {}):
            raise KeyError(name)
        schema = _schema(state["schemas"][name])
        every = StructType(list(schema.fields)).add("_writer", "string").add("_batch", "long")
        rows = self.spark.read.schema(every).parquet(f"{self.path}/{name}")
        seen = F.lit(False)
        for writer, last in state["done"].items():
            seen = seen | ((F.col("_writer") == writer) & (F.col("_batch") <= last))
        return rows.where(seen)

    def drain(self, stream: DataFrame, checkpoint: str, partitions: int | None = None) -> None:
        """Runs the stream into the tables until what is there now is done."""
        from ..streaming import state_settings

        with state_settings(self.spark, partitions):
            writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
            writer.trigger(availableNow=True).start().awaitTermination()
