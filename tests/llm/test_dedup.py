import hashlib
import random
import re


import numpy as np
import pytest

from learnloom.llm import embedding_dedup, exact_dedup, simhash, substring_dedup
from learnloom.llm.common import connected_components


def test_exact_duplicates_match_brute_force(spark, docs):
    rows = [(5, "a  b"), (3, "a\t\nb"), (9, None), (2, ""), (7, "a b "), (8, "A b"), (4, "x" * 200_000), (6, "x" * 200_000), (None, "a b"), (None, "only null ids")]
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_duplicates(docs(rows)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            r = got[i, hashlib.sha256(text.encode()).hexdigest()]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), i == keep)


def test_exact_dedup_keeps_one_of_repeated_rows_and_columns(docs):
    df = docs([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (3, None), (4, "")])
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "b"), (1, "a"), (3, None)]
    assert exact_dedup.drop_exact_duplicates(df.where("false")).count() == 0
    assert exact_dedup.exact_duplicates(df.where("false")).count() == 0


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.exact_duplicates(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_runs_are_merged_in_order_without_another_exchange(spark, docs):
    rows = [(i, f"text {i % 7}") for i in range(300)] + [(None, "text 3")] * 100
    entries = exact_dedup.digests(docs(rows).repartition(9), 16)
    one = exact_dedup.merged(entries.withColumnRenamed("doc_id", "keep_id").selectExpr("*", "1L AS group_size"), 4)
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "Window" in plan
    tree = exact_dedup.merged_runs(entries, 2, 4)
    assert [t.select("run").distinct().count() for t in tree] == [9, 3, 1]
    assert {(r["keep_id"], r["group_size"]) for r in tree[-1].collect()} == {(k, sum(i % 7 == k for i in range(300)) + 100 * (k == 3)) for k in range(7)}
    for level in tree:  # each file holds whole slices, sorted
        for f in level.inputFiles():
            keys = [(r["run"], r["text_sha256"]) for r in spark.read.parquet(f).collect()]
            assert keys == sorted(set(keys))


def test_connected_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(1000, 1200)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: find(n) for n in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^ \t-\r]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "  ", "One", "a b c", "A b c D e f g", "é " * 9 + "x\x0by", "w " * 70_000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_near_pairs_match_brute_force():
    import numpy as np

    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = [c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) for c in centres for _ in range(40)]
    fps = np.array(sorted(f & (2**64 - 1) for f in set(fps)), np.uint64)
    begins = np.array([0, 70, 71])
    i, j = simhash.near_pairs(fps, begins)
    group = np.searchsorted(begins, np.arange(len(fps)), "right")
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if group[a] == group[b] and bin(int(fps[a] ^ fps[b])).count("1") <= 4}
    assert set(zip(i.tolist(), j.tolist())) == want and want


def test_simhash_components_match_brute_force(spark, docs, monkeypatch):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(12)]
    rows = [(100 - i, t) for i, t in enumerate(base)]
    for k, t in enumerate(base * 4):
        words = t.split()
        words[rng.randrange(len(words))] = f"new{k}"
        rows.append((200 + k, " ".join(words)))
    rows += [(7, None), (3, ""), (5, " \n"), (400, base[0]), (401, base[0].upper())]
    monkeypatch.setattr(simhash, "BLOCK", 3)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(rows)).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    for i in fps:
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            new = [y for y in fps if y not in seen and bin(fps[x] ^ fps[y]).count("1") <= 4]
            seen |= set(new)
            todo += new
        assert got[i]["component_id"] == min(seen)
    df = docs(rows)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in got.values()})
    assert simhash.near_duplicates(df.where("false")).count() == 0


def slow_substring(rows, n):
    """(id, words, removed, kept) of each row, by the order of ids and, for one id, of the texts' hashes (``rows`` has them)."""
    seen, out = set(), []
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        words, gone = re.findall(r"[^ \t-\r]+", text or ""), set()
        for s in range(len(words) - n + 1):
            w = tuple(words[s : s + n])
            if w in seen:
                gone |= set(range(s, s + n))
            seen.add(w)
        out.append((i, len(words), len(gone), " ".join(x for k, x in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def substring_results(df, n):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.without_repeats(df, n).collect()), key=str)


def hashed(df):
    from pyspark.sql import functions as F

    return [tuple(r) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]


def test_substring_dedup_of_repeated_rows_and_ids(docs, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage)] * 3 + [(None, passage), (None, f"own words {passage}"), (None, "short"), (2, f"a b {passage}"), (2, f"{passage} c"), (2, "x y"), (2, "x y"), (5, None), (5, None)]
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 20)
    df = docs(rows).repartition(3)
    got = substring_results(df, 5)
    assert got == slow_substring(hashed(df), 5)
    assert sum(kept.count("p29") for *_, kept in got) == 1  # one copy of the passage stays
    same = docs([(1, passage)] * 2)
    assert substring_results(same, 20) == [(1, 30, 0, passage), (1, 30, 30, "")]


def test_substring_dedup_matches_brute_force(docs, monkeypatch):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(40)]
    rows += [(100 + i, f"{passage} tail{i} {passage}") for i in range(30)] + [(50, None), (51, ""), (52, "a " * 5000), (60, "é x " * 25)]
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 150)
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 100)
    df = docs(rows)
    assert substring_results(df, 5) == slow_substring(hashed(df), 5)
    assert substring_dedup.kept_digests(docs(rows).where("false")).count() == 0


def test_rolling_hash_depends_on_words_only():
    import numpy as np

    words = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    twice = np.concatenate([words, words])
    for base in substring_dedup.BASES:
        h = substring_dedup.rolling_hashes(twice, 20, base)
        assert (h[:31] == h[50:]).all() and len(set(h.tolist())) == 50


def test_packed_places_round_trip():
    import numpy as np

    doc, part, start = np.array([-5, -5, 9, 9, 2**62]), np.array([0, 0, -3, 7, 0]), np.array([0, 7, 2**31, 1, 3], np.uint32)
    got = substring_dedup.unpacked(substring_dedup.packed(doc, part, start))
    assert all((g == w).all() for g, w in zip(got, (doc, part, start)))


def test_embedding_links_match_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 8))
    rows = [(1000 - i, (centres[i % 60] + rng.normal(size=8) * 0.12).tolist()) for i in range(700)]
    rows += [(2000 + i, rows[0][1]) for i in range(5)] + [(1, None), (2, [0.0] * 8), (3, [float("nan")] + [1.0] * 7), (4, [1.0, None] + [0.0] * 6), (5, [1.0, 2.0])]
    monkeypatch.setattr(embedding_dedup, "CELLS", 1.5)
    monkeypatch.setattr(embedding_dedup, "COSINES", 1000)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    good = {i: np.array(v) for i, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    x = np.stack([good[i] for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    root = np.arange(len(ids))
    while True:
        new = np.where(near, root[None, :], len(ids)).min(1)
        if (new == root).all():
            break
        root = new
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"]) == (near[k].sum() - 1, ids[root[k]])
    for i in (1, 2, 3, 4, 5):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embedding_dedup.near_duplicate_vectors(df.where("false")).count() == 0


def test_centroids_are_the_same_on_the_driver_and_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    sample = spark.createDataFrame([(r.tobytes(), i) for i, r in enumerate(x)], "unit binary, order long").repartition(3).cache()
    one = embedding_dedup.fit_centroids(sample, 5, 12)
    monkeypatch.setattr(embedding_dedup, "LOCAL_VECTORS", 0)
    monkeypatch.setattr(embedding_dedup, "COSINES", 100)
    two = embedding_dedup.fit_centroids(sample, 5, 12)
    assert one.shape == (12, 5) and np.allclose(one, two, atol=1e-9)


def test_similar_sets_hold_few_pairs_at_a_time():
    import tracemalloc

    sets = [np.arange(5, dtype=np.uint64) + np.uint64(10 * i) for i in range(6000)]
    tracemalloc.start()
    i, j = simhash.similar_sets(sets, sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (i == j).all() and len(i) == 6000 and peak < 150e6
