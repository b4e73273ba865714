"""Pieces that several training-data operators share: shared storage, ranks, connected components."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import remove, replaced, scope, shared_path, shuffle_partitions, stored

__all__ = [
    "SPACES", "WORDS", "bucket_of", "connected_components", "first_by_hash", "free_name", "remove", "replaced", "running_total", "scope", "shared_path", "shuffle_partitions", "stored", "table", "usable_parts",
]

#: White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def usable_parts(column: pa.ListArray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of vectors: the rows that are not null and have no null or non-finite part, their lengths, and the
    parts, ``scale`` times each, one after another in double precision."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lengths = pc.list_value_length(column).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore"):
        parts = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale  # null parts become NaN
    ends = np.concatenate([[0], np.cumsum(lengths)])
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(parts))])
    good = wrong[ends[1:]] == wrong[ends[:-1]]
    return rows[good], lengths[good], parts[np.repeat(good, lengths)]


def bucket_of(n: Column, *keys: Column | str) -> Column:
    """A number from 0 below sqrt(n) by the hash of ``keys``: a group of n rows gets about sqrt(n) buckets of sqrt(n) rows."""
    return F.pmod(F.xxhash64(*keys), F.ceil(F.sqrt(n)).cast("long"))


def first_by_hash(rows: DataFrame, group: str, keys: list[str], n: int, columns: list[str]) -> list[Row]:
    """The first ``n`` rows of each group (not null) in order of a hash of ``keys``, all if there are fewer.

    Hashes are even, so a share of them that holds about three times as many rows is looked through first, and what is
    sent to a group's task does not grow with the input. A group that comes out short, since its rows repeat, is looked
    through whole. One row for each group comes to the driver for this.
    """
    counts = {r[group]: r["count"] for r in rows.groupBy(group).count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for g, c in counts.items() for x in (g, min(1.0, (3 * n + 100) / c))])
    order, rank = free_name(rows, "order"), free_name(rows, "rank")
    hashed = rows.withColumn(order, F.pmod(F.xxhash64(*keys), F.lit(2**40)))

    def first(some: DataFrame) -> list[Row]:
        # Spark limits each task's rows before it deals them out.
        ranked = some.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(order)))
        return ranked.where(F.col(rank) <= n).select(*columns).collect()

    found = first(hashed.where(F.col(order) < share[F.col(group)] * 2**40))
    met = Counter(r[group] for r in found)
    short = [g for g, c in counts.items() if met[g] < min(n, c)]
    if short:
        found = [r for r in found if r[group] not in set(short)] + first(hashed.where(F.col(group).isin(short)))
    return found


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: columns ``node`` and ``root``, the smallest node of its component.

    ``edges`` has columns ``a`` and ``b``; nodes without an edge, and edges with a null end, do not appear. Rounds of large-star and small-star
    (Kiveris et al. 2014) shorten paths until every node hangs from its root. The minimum of each node is a partial
    aggregation, and it is stored before it is joined back, so that the join is between two plain exchanges, whose
    large partitions Spark splits when one node has a large share of the edges. The tables of a round are removed when
    the next one stands.
    """

    def joined_to_minimum(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        low = stored(pairs.groupBy("u").agg(F.min("v").alias("m")))
        return pairs.join(low, "u"), low

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, low = joined_to_minimum(both)
        large = stored(met.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        replaced(low, large)
        met, low = joined_to_minimum(large)
        star = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = replaced(now, stored(met.select(F.inline(star)).where("u <> v").distinct()))
        replaced(low, replaced(large, now))
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def running_total(rows: DataFrame, key: list[str], bucket: str, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the total of ``value`` over the rows of ``key`` that come before, in order of ``bucket``, then ``order``.

    Two levels: totals of each (key, bucket) are summed over the buckets of a key, then over the rows of one bucket, so
    that no task gets all rows of a key that holds a large share of them. Null keys are a key (structs compare so).
    """
    base, own, group = free_name(rows, "base"), free_name(rows, "own"), free_name(rows, "group_key")
    rows = rows.withColumn(own, value).withColumn(group, F.struct(*key))
    totals = rows.groupBy(group, bucket).agg(F.sum(own).alias(base))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn(name, F.coalesce(F.sum(own).over(inside), F.lit(0)))
        .join(bases, [group, bucket])
        .withColumn(name, F.col(name) + F.col(base))
        .drop(base, own, group)
    )
