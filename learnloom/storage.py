"""Intermediate tables in the folder that the driver and all executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths that each open scope of a thread wrote, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_path(spark: SparkSession, kind: str = "learnloom") -> str:
    """A new path below the checkpoint folder, which the driver and all executors share.

    The session names the folder in spark.checkpoint.dir. Without it a local session gets a temporary one; any other
    session must name it, because a machine-local folder would hide files from other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes the shuffle files of a query when the query ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, scoped: bool = True) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut and a lost executor loses nothing.

    An open :func:`scope` removes it at its end, unless ``scoped`` is false. Its shuffle files go when it is written, since
    nothing reads them again; otherwise those of all steps would stay until the driver happens to collect its garbage.
    """
    path = shared_path(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    if scoped and _scopes.get():
        _scopes.get()[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder from whatever file system holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """``new``, which is stored and no longer reads ``old``; the files of ``old`` are removed."""
    if old is not None and getattr(old, "stored_path", None):
        remove(new.sparkSession, old.stored_path)
    return new


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what :func:`stored` wrote within it. What is lazy must have been written or collected by then."""
    paths: list[str] = []
    before = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in paths:
            remove(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
