"""Exact deduplication by a tree of merged, sorted digest runs, in DataFrame operations only.

What one partition of the input holds is a run: its entries (digest, smallest id, number of rows) sorted by digest. In each
round, ``fan_in`` neighbouring runs are sent to one partner (run ``r`` to run ``r // fan_in``, the binomial tree with several
children) and merged there: entries of one digest come to stand next to each other, and the first, which has the smallest
id, stays with the sum of their rows. The fewer runs there are, the more slices of the digests' range a run is cut into,
each in order and each merged in a task of its own, so every round uses as many tasks as the first. The last run has the
smallest id of every text. The verdicts then walk down the same tree: an entry asks its parent only, and a text that a
third of all rows share is answered once for each run instead of in one task.

A digest is the SHA-256 of the normalised text together with its length in bytes; entries merge only if both agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, free_name, shuffle_partitions, stored

KEY = ["text_sha256", "n_bytes"]


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def tree_levels(spark, fan_in: int) -> int:
    """Rounds that bring at least as many runs as there are shuffle partitions down to one; two at least."""
    levels = 2
    while fan_in**levels < shuffle_partitions(spark):
        levels += 1
    return levels


def digests(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, run, text_sha256, n_bytes: one row for each document. A partition is a run, or shares one."""
    text = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.spark_partition_id() % runs).cast("long").alias("run"),
        F.sha2(text, 256).alias("text_sha256"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def merged(entries: DataFrame, slices: int) -> DataFrame:
    """Entries (run, digest, keep_id, group_size) with each digest of a run once, in order of run and digest.

    A run is dealt to tasks by slices of the digests' range. A task sorts what its runs sent, and an entry stays if its
    neighbour before it has another digest; ids are in order within a digest, null last.
    """
    part = F.floor(F.conv(F.substr("text_sha256", F.lit(1), F.lit(6)), 16, 10).cast("long") * slices / 2**24)
    order = F.col("keep_id").asc_nulls_last()
    dealt = entries.withColumn("slice", part).repartition("run", "slice").sortWithinPartitions("run", "slice", *KEY, order)
    same = Window.partitionBy("run", "slice", *KEY).orderBy(order)
    every = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = dealt.withColumn("place", F.row_number().over(same)).withColumn("group_size", F.sum("group_size").over(every))
    return met.where("place = 1").select(*KEY, "run", "keep_id", "group_size")


def merged_runs(entries: DataFrame, levels: int, fan_in: int) -> list[DataFrame]:
    """The runs at each level, from those of the input's partitions to the one merged run; each level is stored."""
    tree = [stored(merged(entries.withColumnRenamed("doc_id", "keep_id").withColumn("group_size", F.lit(1).cast("long")), 1))]
    for level in range(1, levels + 1):
        tree.append(stored(merged(tree[-1].withColumn("run", F.floor(F.col("run") / fan_in)), fan_in**level)))
    return tree


def run_verdicts(tree: list[DataFrame], fan_in: int) -> DataFrame:
    """For each (digest, run) of the lowest level: keep_id and group_size of the whole corpus."""
    known = tree[-1]
    for level in reversed(tree[:-1]):
        parent = known.withColumnRenamed("run", "parent")
        known = (
            level.select(*KEY, "run", F.floor(F.col("run") / fan_in).alias("parent"))
            .join(parent, [*KEY, "parent"])
            .drop("parent")
        )
    return known


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are. A null text is the empty text. A null id is larger than any other;
    a group of null ids only has a null keep_id. Of repeated rows (same id, same text) each gets kept = true; use
    :func:`drop_exact_duplicates` to keep one of them. An empty table gives an empty result; extra columns are ignored.
    """
    levels = tree_levels(docs.sparkSession, fan_in)
    entries = stored(digests(docs, fan_in**levels, id_col, text_col))
    verdicts = run_verdicts(merged_runs(entries, levels, fan_in), fan_in)
    return entries.join(verdicts, [*KEY, "run"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with their columns unchanged.

    The row with the smallest id stays (nulls last); of repeated rows of that id and text, one stays.
    """
    levels = tree_levels(docs.sparkSession, fan_in)
    entries = digests(docs, fan_in**levels, id_col, text_col)
    best = merged_runs(entries, levels, fan_in)[-1]
    sha, size, key, rank = (free_name(docs, c) for c in ("text_sha256", "n_bytes", "id_key", "rank"))
    text = normalised(F.col(text_col))
    # Structs compare nulls as equal, so one key serves the join and the window and the texts are dealt once.
    best = best.select(
        F.col("text_sha256").alias(sha), F.col("n_bytes").alias(size), F.struct(F.col("keep_id").alias("id")).alias(key)
    )
    marked = (
        docs.withColumn(sha, F.sha2(text, 256))
        .withColumn(size, F.octet_length(text).cast("long"))
        .withColumn(key, F.struct(F.col(id_col).alias("id")))
    )
    one = Window.partitionBy(sha, size, key).orderBy(text_col)
    return (
        marked.join(best, [sha, size, key], "left_semi")
        .withColumn(rank, F.row_number().over(one))
        .where(F.col(rank) == 1)
        .select(*docs.columns)
    )
