"""Similar concept names within a book: exact joins by a prefix filter, and greedy grouping as a maximal independent set.

The similarity is the Ratcliff/Obershelp ratio ``2 M / (len a + len b)`` of Python's difflib. Equal characters that match
are part of the common multiset of characters, so a ratio above ``t`` needs an overlap above ``t (la + lb) / 2``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..storage import replaced, shuffle_partitions, stored
from .joins import matched

#: Rows of a name for each length of a partner, wherever two characters a row are enough for that.
MOST_KEYS = 64


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _tokens(name: Column) -> Column:
    """Characters with their number of occurrence, so that a multiset is a set."""
    chars = F.array_sort(F.split(name, ""))
    return F.transform(F.arrays_zip(chars.alias("c"), F.transform(chars, lambda c, i: i).alias("i")), lambda z: F.concat_ws("#", z["c"], (z["i"] - F.array_position(chars, z["c"]).cast("int") + 1).cast("string")))


def similar_pairs(names: DataFrame, threshold: float, late_first: bool = False) -> DataFrame:
    """Pairs of similar names of a book, the earlier by ``seq`` as a: book_id, a, i, b, j, ratio.

    ``names`` has book_id, name and seq, each name of a book once. The ratio of difflib depends on the order of its
    arguments; it is that of (a, b), or of (b, a) with ``late_first``. A pair of lengths n and m is similar only if
    at least o = floor(t (n + m) / 2) + 1 characters are common. The r rarest of these are among the rarest n - o + r of the one
    and m - o + r of the other, for each r up to o, so each name has a row for each length that a partner may have and each choice
    of r among these; book, both lengths and the choice are the key. No pair is lost. r is as large as ``MOST_KEYS`` choices
    allow, but two at least (one, if o is 1): most often it is o, and then only pairs with enough in common meet. Those whose edit
    distance rules a similar order out are dropped before ratios are computed.
    """
    # A book is a struct, so that a null one is equal to itself.
    rows = names.where("name <> ''").select(F.struct("book_id").alias("book"), "name", "seq", _tokens(F.col("name")).alias("tokens")).withColumn("n", F.size("tokens"))
    each = rows.select("book", "name", "seq", "n", F.explode("tokens").alias("token"))
    counts = each.groupBy("book", "token").agg(F.count("*").alias("df"))
    ordered = each.join(counts, ["book", "token"]).groupBy("book", "name", "seq", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    tokens = stored(ordered.select("book", "name", "seq", "n", F.transform("t", lambda x: x["token"]).alias("tokens")))
    slack = 1e-9
    lengths = sorted(r[0] for r in tokens.select("n").distinct().collect())
    shapes, choices = _shapes(lengths, threshold, slack)
    spark = names.sparkSession
    if not shapes:
        shapes, choices = [(0, 0, 0, 0, 0)], [(0, 0, [])]
    partner = F.broadcast(spark.createDataFrame(shapes, "n int, m int, o int, p int, r int"))
    chosen = F.broadcast(spark.createDataFrame(choices, "p int, r int, picks array<array<int>>"))
    # Rows of names are few and multiply here: they are dealt out before.
    keyed = tokens.repartition(shuffle_partitions(spark), "book", "name").join(partner, "n").join(chosen, ["p", "r"])
    prefix = F.array_sort(F.slice("tokens", 1, F.col("p")))
    keyed = keyed.withColumn("prefix", prefix).withColumn("pick", F.explode("picks"))
    keyed = keyed.select(
        "book", "name", "seq", "n", F.least("n", "m").alias("short"), F.greatest("n", "m").alias("long"), (F.col("n") + F.col("m")).alias("both"),
        F.xxhash64(F.transform("pick", lambda i: F.element_at("prefix", i))).alias("key"),
    )
    on = ["book", "short", "long", "both", "key"]
    side = lambda name, seq: keyed.select(*on, F.col("name").alias(name), F.col("seq").alias(seq), F.col("n").alias(f"n{name}"))
    # Spark takes the rows of names for their size before they are multiplied, and would send them whole through the driver.
    met = side("a", "i").hint("merge").join(side("b", "j").hint("merge"), on).where((F.col("i") < F.col("j")) & (F.col("na") + F.col("nb") == F.col("both")))
    # What matches is a common subsequence, and the rest of both can be deleted and inserted.
    near = F.levenshtein("a", "b") <= (F.length("a") + F.length("b")) * (1 - threshold) + slack
    met = stored(met.where(near).select("book", "a", "i", "b", "j").distinct())
    value = ratio("b", "a") if late_first else ratio("a", "b")
    return met.select("book.book_id", "a", "i", "b", "j", value.alias("ratio")).where(F.col("ratio") > threshold)


def _shapes(lengths: list[int], threshold: float, slack: float) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, list[list[int]]]]]:
    """For lengths n, and m of a partner: the common characters o that a similar pair has, the rarest p to choose from, and
    the r to choose (n, m, o, p, r); then the choices of r among p, as places from 1 (p, r, picks)."""
    shapes = []
    for n in lengths:
        for m in lengths:
            o = math.floor((n + m) * (threshold / 2) - slack) + 1
            if o <= min(n, m):
                spare = max(n, m) - o
                r = max((r for r in range(1, o + 1) if math.comb(spare + r, r) <= MOST_KEYS), default=1)
                r = max(r, min(2, o))
                shapes.append((n, m, o, n - o + r, r))
    return shapes, [(p, r, [list(c) for c in combinations(range(1, p + 1), r)]) for p, r in sorted({s[3:] for s in shapes})]


def near_duplicate_concepts(points: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of points of a book, i before j by ``seq``, whose names differ and are similar: book_id, i, j, ratio.

    Pairs of equal names are not expanded; their number follows from the counts of the names.
    """
    firsts = stored(points.groupBy("book_id", F.col("concept").alias("name")).agg(F.min("seq").alias("seq")))  # read twice
    return similar_pairs(firsts, threshold).select("book_id", "i", "j", F.col("a").alias("concept_i"), F.col("b").alias("concept_j"), "ratio")


def group_similar_concepts(points: DataFrame, threshold: float = 0.85, max_rounds: int = 200) -> DataFrame:
    """Points with ``leader``, the ``seq`` of the leader of their group: the earliest leader of the book that is similar.

    A name that is similar to no earlier leader leads. These leaders are the lexicographically first maximal independent
    set of the similarity graph in order of ``seq`` and are found in rounds: who has an earlier leader as neighbour is a
    member; who has neither an earlier leader nor an undecided earlier neighbour leads.
    """
    firsts = stored(points.groupBy("book_id", "concept").agg(F.min("seq").alias("seq")))
    pairs = similar_pairs(firsts.withColumnRenamed("concept", "name"), threshold, late_first=True)
    book = F.struct("book_id").alias("book")  # books number their points alike, and a null one is equal to itself
    edges = stored(pairs.select(book, F.col("j").alias("late"), F.col("i").alias("early")))
    state = stored(firsts.select(book, "seq", F.lit(0).alias("state")))  # 0 undecided, 1 leader, 2 member
    for _ in range(max_rounds):
        met = edges.join(state.select("book", F.col("seq").alias("early"), F.col("state").alias("s")), ["book", "early"]).groupBy("book", F.col("late").alias("seq"))
        met = met.agg(F.max((F.col("s") == 1).cast("int")).alias("led"), F.max((F.col("s") == 0).cast("int")).alias("open"))
        now = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("led", F.lit(0)) == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        state = replaced(state, stored(state.join(met, ["book", "seq"], "left").select("book", "seq", now.alias("state"))))
        if state.where("state = 0").isEmpty():
            break
    else:
        raise RuntimeError(f"grouping did not settle in {max_rounds} rounds")
    led_by = edges.join(state.where("state = 1").select("book", F.col("seq").alias("early")), ["book", "early"])
    leaders = led_by.groupBy("book", F.col("late").alias("seq")).agg(F.min("early").alias("first"))
    led = state.join(leaders, ["book", "seq"], "left").select("book.book_id", "seq", F.when(F.col("state") == 1, F.col("seq")).otherwise(F.col("first")).alias("leader"))
    named = matched(firsts, led, ["book_id", "seq"]).select("book_id", "concept", "leader")
    return matched(points, named, ["book_id", "concept"])


def brute_force_groups(rows: Iterator[tuple[int, str]], threshold: float = 0.85) -> dict[int, int]:
    """The sequential definition, for tests: seq -> leader's seq."""
    leaders: list[tuple[int, str]] = []
    out = {}
    for seq, name in sorted(rows):
        out[seq] = next((s for s, n in leaders if sequence_ratio(name, n) > threshold), seq)
        if out[seq] == seq:
            leaders.append((seq, name))
    return out
