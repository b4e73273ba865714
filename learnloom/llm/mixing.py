"""Mixing sources to target weights along a time-varying curriculum.

Training time ``t`` runs from 0 to 1 and counts words. A source with target ``T`` has at time ``t`` the share
``T (1 - a + 2 a t)`` of the words: with a positive slope ``a`` it comes late, with a negative one early. The slopes are
taken relative to their mean over the targets, so that the shares of all sources together are 1 at every time, and each
source's integral over all time is its target. Documents of a source stand in order of a hash. The words before the middle of a copy
are the cumulative demand at which it is used; inverting the integral ``T ((1 - a) t + a t^2)`` gives its position. A
copy that the demand does not reach by time 1 has no position and is not taken. Sorting by position by ranges gives
the training order.

Sources are configuration: one row for each of them comes to the driver, never a row for each document. Their plan is a
table that is joined.
"""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, free_name, running_total, shuffle_partitions, stored

WEIGHTS, SLOPES, MOST_REPEATS = (5, 2, 1), (-0.5, 0.0, 0.5), 3
HASHES = 2**32
#: Up to so many sources the plan is broadcast (some 100 bytes each); beyond that it is joined by exchange.
BROADCAST_SOURCES = 100_000


@dataclass
class Source:
    """What the mix takes from one source."""

    name: str | None
    buckets: int  # parts that its documents are ordered in
    size: int
    target: float
    slope: float
    passes: int = 0  # how often every document is taken whole
    gap: float = 0.0  # words that are missing after the partial pass
    turned: int = -1  # the words before the one document whose choice is turned round, to come nearer to the target


PLAN = "key string, buckets long, size long, target double, slope double, passes int, gap double, turned long"


def shares(sizes: list[int], weights: list[float], most: int = MOST_REPEATS) -> list[float]:
    """Targets by weight that share the sum of ``sizes``, none above ``most`` times its size; the excess is reshared by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    rest, weight, out = sum(sizes), sum(weights), [0.0] * len(sizes)
    for k, i in enumerate(order):
        if most * sizes[i] / weights[i] > rest / weight:
            for j in order[k:]:
                out[j] = weights[j] * (rest / weight)
            break
        out[i] = float(most * sizes[i])
        rest, weight = rest - most * sizes[i], weight - weights[i]
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def sources_of(sized: DataFrame, weights=WEIGHTS, slopes=SLOPES, most: int = MOST_REPEATS) -> list[Source]:
    """The sources of rows (source, size) in order of code points, null last, with targets and slopes."""
    found = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    # Python compares strings by code point.
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    targets = shares([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
    own = [slopes[i % len(slopes)] for i in range(len(found))]
    total = sum(targets)
    mean = sum(t / total * a for t, a in zip(targets, own)) if total else 0.0
    return [
        Source(r["source"], max(1, math.ceil(math.sqrt(r["n"]))), r["size"], t, a - mean, math.floor(t / r["size"]) if r["size"] else 0)
        for r, t, a in zip(found, targets, own)
    ]


def _planned(rows: DataFrame, sources: list[Source], names: dict[str, str]) -> DataFrame:
    """Adds the plan of each row's source as a struct; a null source has its own."""
    table = rows.sparkSession.createDataFrame([astuple(s) for s in sources], PLAN)
    table = table.select(F.col("key").alias(names["key"]), F.struct(*table.columns[1:]).alias(names["plan"]))
    table = F.broadcast(table) if len(sources) <= BROADCAST_SOURCES else table
    return rows.join(table, F.col(names["source"]).eqNullSafe(F.col(names["key"]))).drop(names["key"])


def _placed(rows: DataFrame, sources: list[Source], names: dict[str, str]) -> DataFrame:
    """Adds the plan and the number of words before each document in its source's order."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(names["id"]).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    rows = _planned(rows, sources, names).withColumn(names["hash"], hashed)
    rows = rows.withColumn(names["bucket"], F.floor(F.col(names["hash"]) * F.col(names["plan"])["buckets"] / HASHES))
    order = [names["hash"], names["id"], names["size"]]
    return running_total(rows, [names["source"]], names["bucket"], order, F.col(names["size"]), names["before"])


def _reached(names: dict[str, str], copy: Column) -> Column:
    """The share of its source's demand that lies before the middle of a copy; null if the source has no words."""
    plan = F.col(names["plan"])
    words = copy * plan["size"] + F.col(names["before"]) + F.col(names["size"]) / 2
    return F.when(plan["target"] > 0, words / plan["target"])


def _times(names: dict[str, str]) -> Column:
    """Positions of all copies that the mix takes of a document, in order."""
    plan = F.col(names["plan"])
    a = plan["slope"]
    turned = (F.col(names["before"]) == plan["turned"]) & (F.col(names["size"]) > 0)

    def position(copy: Column) -> Column:
        x = _reached(names, copy)
        inverse = 2 * x / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * x))
        last = copy == plan["passes"]
        return F.when(last & turned, F.when(x > 1, F.lit(1.0))).when(x <= 1, F.least(inverse, F.lit(1.0)))

    return F.filter(F.transform(F.sequence(F.lit(0), plan["passes"]), position), lambda t: t.isNotNull())


def _brought_nearer(placed: DataFrame, sources: list[Source], names: dict[str, str]) -> list[Source]:
    """The sources with the document, of about the size that is missing, whose choice brings each nearest to its target."""
    chosen, size = F.coalesce(_reached(names, F.col(names["plan"])["passes"]) <= 1, F.lit(False)), F.col(names["size"])
    taken = placed.groupBy(names["source"]).agg(F.sum(F.when(chosen, size)).alias("taken")).collect()
    taken = {r[0]: r["taken"] or 0 for r in taken}
    for s in sources:
        s.gap = s.target - s.passes * s.size - taken.get(s.name, 0)
    rows, gap = _planned(placed.drop(names["plan"]), sources, names), F.col(names["plan"])["gap"]
    off = F.abs(F.abs(gap) - size)
    found = (
        rows.where((size > 0) & (chosen == (gap < 0)) & (off < F.abs(gap)))
        .groupBy(names["source"])
        .agg(F.min(F.struct(off.alias("off"), F.col(names["before"]).alias("before"))).alias("best"))
        .collect()
    )
    found = {r[0]: r["best"]["before"] for r in found}
    for s in sources:
        s.turned = found.get(s.name, -1)
    return sources


def _names(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> dict[str, str]:
    inner = ("size", "hash", "bucket", "before", "position", "key", "plan")
    return {"id": id_col, "source": source_col} | {c: free_name(docs, c) for c in inner}


def _sized(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return rows, _names(rows) | {"size": "size"}


def source_mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, most: int = MOST_REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies and position (training time of its first copy).

    ``taken`` is the size of the copies that have a position. Rows are range-partitioned by position and sorted within
    partitions; a document that is not taken has none and comes first. Null sources are a source of their own, the
    last. A null or empty text has size 0 and takes nothing. A source without words has target 0 and no positions. Rows
    that agree in id, source and size are interchangeable. An empty table stays empty.
    """
    sized, names = _sized(docs)
    sources = sources_of(sized, weights, slopes, most)
    placed = stored(_placed(sized, sources, names))
    rows = _planned(placed.drop(names["plan"]), _brought_nearer(placed, sources, names), names)
    rows = rows.withColumn("times", _times(names))
    mixed = rows.select(
        "doc_id",
        "size",
        F.col(f"{names['plan']}.size").alias("source_size"),
        F.round(f"{names['plan']}.target", 6).alias("target"),
        (F.col("size") * F.size("times")).cast("long").alias("taken"),
        F.size("times").alias("copies"),
        F.round(F.get("times", F.lit(0)), 9).alias("position"),
    )
    return mixed.repartitionByRange(shuffle_partitions(docs.sparkSession), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it, with their columns unchanged.

    The result is range-partitioned by position and sorted within partitions. Nulls, ties and empty tables behave as in
    :func:`source_mix`; a document without words stays where its source has words. Texts are moved twice: to be numbered
    within their source, and to their place.
    """
    sized, plain = _sized(docs)
    sources = sources_of(sized, weights, slopes, most)
    sources = _brought_nearer(stored(_placed(sized, sources, plain)), sources, plain)
    names = _names(docs)
    rows = _placed(docs.withColumn(names["size"], word_count(F.col("text"))), sources, names)
    return (
        rows.withColumn(names["position"], F.explode(_times(names)))
        .repartitionByRange(shuffle_partitions(docs.sparkSession), names["position"], names["hash"])
        .sortWithinPartitions(names["position"], names["hash"], "doc_id")
        .select(*docs.columns)
    )
