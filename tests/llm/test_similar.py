import random
from itertools import combinations

import corpus_pipeline
from learnloom.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or bool(a | b) and len(a & b) / len(a | b) >= 0.8


def brute_force(texts):
    """The smallest id that each id is linked to."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        if similar(sets[a], sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


def corpus():
    rng = random.Random(4)
    rows = {}
    for i in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 160))]
        rows[len(rows)] = " ".join(words)
        for _ in range(rng.randrange(4)):  # copies on both sides of the limit
            copy = list(words)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = "changed"
            rows[len(rows)] = " ".join(copy)
    base = [f"h{i}" for i in range(80)]
    for i in range(150):  # one large group
        rows[len(rows)] = " ".join(base[:-1] + [f"end{i}"])
    return rows | {9000: "", 9001: None, 9002: "one two", 9003: "One  two", 9004: "one three"}


def test_stage_keeps_what_brute_force_jaccard_keeps(spark, docs):
    texts = corpus()
    root = brute_force(texts)
    df = docs(list(texts.items()))
    kept = corpus_pipeline.drop_near(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in root.items() if r == i)


def test_stage_takes_repeated_rows_null_ids_and_no_rows(spark, docs):
    words = [f"w{i}" for i in range(100)]
    one, near, other = " ".join(words), " ".join(words[:-1] + ["x"]), " ".join(reversed(words))
    rows = [(None, one), (3, near), (3, near), (4, one), (5, other)]
    kept = simhash.drop_similar(docs(rows))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, near), (3, near), (5, other)]
    assert simhash.drop_similar(docs(rows).where("false")).count() == 0
