"""Vector and lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from learnloom.llm import lexical_search, vector_search


def slow_products(rows, every, k):
    """Rows (vec_id, parts): for each query row its best candidates, in whole numbers cut to 64 bits."""
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for a, (q, x) in enumerate(usable):
        if q % every == 0:
            near = lambda n: max(-(2**63) + 1, min(2**63 - 1, n))
            scores = [(-near(sum(s * t for s, t in zip(x, y))), c) for b, (c, y) in enumerate(usable) if b != a and len(x) == len(y)]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS dim", "'x' AS shard", "2 AS row_no").repartition(3)


@pytest.mark.parametrize("shard,block,leaf", [(40, 5, 4), (1000, 1000, 16), (7, 2, 1)])
def test_products_match_brute_force(spark, shard, block, leaf):
    rng = random.Random(shard)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(base)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(90)]  # a third are copies of a query
    rows += [(300, None), (305, [None] * 6), (310, [math.nan] * 6), (315, [math.inf] + [0.0] * 5), (None, rows[1][1]), (320, [0.0] * 6), (325, [-1.0, 2.0]), (326, [1.0, 0.5]), (-5, rows[3][1])]
    got = vector_search.top_products(vectors(spark, rows), every=5, k=4, shard=shard, block=block, leaf=leaf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == slow_products(rows, 5, 4)


def test_odd_vectors(spark):
    found = lambda rows, kind="double": sorted(map(tuple, vector_search.top_products(vectors(spark, rows, kind), every=5, k=3, shard=4).collect()))
    assert found([]) == [] and found([(5, [1.0])]) == [] and found([(1, [1.0]), (2, [2.0])]) == []
    assert found([(5, []), (6, []), (7, [1.0])]) == [(5, 1, 6, 0)]
    large = [(5, [1e15, -2e15]), (6, [3e14, 1.0]), (7, [1e12 + 0.125, 4.0]), (8, [-1e15, 0.0]), (9, [1e300, 0.0]), (11, [-1e300, 1.0]), (10, [0.5, 0.25])]
    assert found(large) == slow_products(large, 5, 3)
    twice = [(5, [1.0, 2.0]), (5, [1.0, 3.0]), (6, [1.0, 1.0])]
    assert found(twice) == slow_products(twice, 5, 3)


def slow_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def slow_ranks(docs, items, k):
    counts = [(i, Counter(slow_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(slow_terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        if item is not None:
            out += [(item, n, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("item_bytes,scores", [(10**6, 2_000_000), (60, 20)])
def test_ranks_match_brute_force(spark, monkeypatch, item_bytes, scores):
    monkeypatch.setattr(lexical_search, "SCORES", scores)
    rng = random.Random(4)
    word = lambda: rng.choice(["The", "the", "é", "É", "naïve", "x_1", "a-b", "Zz9", "指针", " ", "it's", "ÀB"] + [f"w{i}" for i in range(30)])
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(120)] + [(500, None), (501, ""), (502, "?! --"), (None, "w1 w2 é"), (503, text(40_000))]
    docs += [(600 + i, "w3 the same text") for i in range(60)] + [(7, "w1 again")] * 3
    items = [(i, text(12)) for i in range(15)] + [(50, None), (51, ""), (52, "nowhere"), (None, "w1"), (53, "w1 W1 w1"), (3, "w2")]
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS term", "2 AS item_id").repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS id", "3 AS doc_id")
    got = lexical_search.ranked_documents(left, right, k=4, item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == slow_ranks(docs, items, 4)


def test_empty_sides(spark):
    empty_docs, empty_items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for left, right in ((empty_docs, items), (docs, empty_items), (empty_docs, empty_items), (docs.selectExpr("doc_id", "'' AS text"), items)):
        assert lexical_search.ranked_documents(left, right).collect() == []


def test_lengths_do_not_overflow():
    assert lexical_search.length_term([10**9], 5 * 10**10, 10**13)[0] == 10 + 90 * 10**9 * 5 * 10**10 // 10**13
