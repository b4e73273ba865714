import os
import random

import pytest

from learnloom import storage
from learnloom.operators import containment, similarity
from learnloom.plans import extraction


@pytest.mark.parametrize("most", [500_000, 0])
@pytest.mark.parametrize("gram", [1, 3, 6])
def test_contained_terms_match_brute_force(spark, monkeypatch, most, gram):
    monkeypatch.setattr(containment, "BROADCAST_TERMS", most)
    monkeypatch.setattr(containment, "KEPT_TERMS", 10 if gram == 3 else 1000)
    monkeypatch.setattr(containment, "PIECE", 8)
    rng = random.Random(gram)
    word = lambda n: "".join(rng.choice("abcé指") for _ in range(n))
    texts = [(b, i, word(rng.randrange(0, 40))) for b in ("x", "y", None) for i in range(30)] + [("x", 99, None), ("x", 98, "")]
    terms = sorted({(rng.choice(["x", "y", None]), word(rng.randrange(0, 9))) for _ in range(60)}, key=str)
    rows, names = spark.createDataFrame(texts, "book string, page long, text string"), spark.createDataFrame(terms, "book string, term string")
    got = {tuple(r) for r in containment.contained_terms(rows, ["book", "page"], names, gram, ["book"]).collect()}
    assert got == {(b, i, t) for b, i, x in texts for c, t in terms if b == c and t and x and t in x} and got
    got = {tuple(r) for r in containment.contained_terms(rows, ["book", "page"], names.select("term"), gram).collect()}
    assert got == {(b, i, t) for b, i, x in texts for _, t in terms if t and x and t in x}


def names(rng):
    stems = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))) for _ in range(30)]
    out = set()
    for s in stems:
        for _ in range(4):
            t = list(s)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice("abcdefghz")
            out.add("".join(t + [rng.choice("xy")] * rng.randrange(2)))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.85])
def test_similar_names_match_brute_force(spark, threshold):
    rng = random.Random(7)
    rows = [(b, n, i) for b in ("x", "y") for i, n in enumerate(rng.sample(names(rng), 60))]
    df = spark.createDataFrame(rows, "book_id string, name string, seq long")
    for late in (False, True):
        got = {(r["book_id"], r["i"], r["j"], round(r["ratio"], 9)) for r in similarity.similar_pairs(df, threshold, late).collect()}
        want = set()
        for b, x, i in rows:
            for c, y, j in rows:
                value = similarity.sequence_ratio(y, x) if late else similarity.sequence_ratio(x, y)
                if b == c and i < j and value > threshold:
                    want.add((b, i, j, round(value, 9)))
        assert got == want and want


def test_pairs_and_groups_of_points_match_the_sequential_definition(spark):
    rng = random.Random(2)
    pool = names(rng)
    # Books number their points alike, and one has no name.
    points = [("b", i, rng.choice(pool)) for i in range(90)] + [("c", i, n) for i, n in enumerate(pool[:40])] + [(None, i, n) for i, n in enumerate(pool[20:60])]
    df = spark.createDataFrame(points, "book_id string, seq long, concept string")
    rows = similarity.group_similar_concepts(df).collect()
    assert len(rows) == len(points)
    for book in ("b", "c", None):
        got = {r["seq"]: r["leader"] for r in rows if r["book_id"] == book}
        firsts, own = {}, [(s, n) for b, s, n in points if b == book]
        for s, n in own:
            firsts.setdefault(n, s)
        leader = similarity.brute_force_groups((s, n) for n, s in firsts.items())
        assert got == {s: leader[firsts[n]] for s, n in own}


def test_groups_of_one_book_do_not_reach_another(spark):
    points = spark.createDataFrame([("a", 0, "gamma"), ("a", 1, "gammas"), ("b", 0, "delta"), ("b", 1, "omega")], "book_id string, seq long, concept string")
    got = similarity.group_similar_concepts(points, 0.8).collect()
    assert sorted((r["book_id"], r["seq"], r["leader"]) for r in got) == [("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("b", 1, 1)]


def test_a_null_book_is_a_book_of_its_own(spark):
    from learnloom.operators import mining, pages as pg, relations as rel

    schema = "book_id string, seq long, page long, concept string, definition string, importance int, difficulty int"
    rows = [(1, 0, "stack", "a pile", 5), (2, 1, "stacks", "more than one stack", 3), (3, 2, "heap tree", "no pile of a stack", 3), (4, 3, "heap", "x", 3)]
    books = ("x", None)
    points = spark.createDataFrame([(b, s, p, c, d, i, 3) for b in books for s, p, c, d, i in rows], schema)
    pages = spark.createDataFrame([(b, p, f"1 One\nof stack {p}") for b in books for p in range(5)], "book_id string, page long, text string")

    def by_book(df):
        found = {b: sorted(tuple(v for k, v in r.asDict().items() if k != "book_id") for r in df.collect() if r["book_id"] == b) for b in books}
        assert found["x"] == found[None] and found["x"]
        return found["x"]

    assert by_book(rel.definition_references(points)) == [("heap tree", "stack", "REFERS_TO", 0.7), ("stacks", "stack", "REFERS_TO", 0.7)]
    assert by_book(rel.name_inclusions(points)) == [("heap tree", "heap", "INCLUDES", 0.8), ("stacks", "stack", "INCLUDES", 0.8)]
    assert len(by_book(rel.page_prerequisites(points))) == 3
    assert by_book(rel.curated_relations(points, [("stack", "heap", "IS_A")], ["stack", "heap"])) == [(a, b, "IS_A", 0.75) for a in ("stack", "stacks") for b in ("heap", "heap tree")]
    assert by_book(similarity.near_duplicate_concepts(points))[0][:2] == (1, 2)
    assert by_book(pg.failed_pages(pages.select("book_id", "page"), points)) == [(4,)]
    assert len(by_book(pg.chapter_spans(pages, [r"(\d) ([^\n ]+)"]))) == 5
    assert len(by_book(mining.vocabulary_hits(pages, spark.createDataFrame([("d", "STACK")], "domain string, term string")))) == 5
    chapters, sections = pg.book_chapters(pages, r"(\d) ([^\n]+)"), pg.book_sections(pages, r"(\d)() ([^\n]+)")
    assert len(by_book(pg.chapter_includes_sections(chapters, sections))) == 1
    none = points.where("false")
    left = extraction.strategy_cascade(pages.where("page > 2"), points.where("page = 3"), none, none, none, none)
    assert {p for p, *_ in by_book(left.select("book_id", "page"))} == {3}
    asked = by_book(extraction.extraction_requests(pages, points, spark.createDataFrame([("d", "stack")], "domain string, term string")).where("page is not null"))
    assert sum(s == "vocabulary" for _, s, *_ in asked) == 5


def test_cascade_goes_on_where_nothing_is_found(spark):
    schema = "book_id string, seq long, page long, concept string, definition string, importance int, difficulty int"
    points = lambda *pages: spark.createDataFrame([("b", k, p, f"c{p}", "text of it", 3, 3) for k, p in enumerate(pages)], schema)
    pages = spark.createDataFrame([("b", p, "stack是指后进先出的结构。" if p == 5 else "nothing") for p in range(1, 8)], "book_id string, page long, text string")
    got = extraction.strategy_cascade(pages, points(1, 1, 2), points(1, 2, 3), points(1, 3), points(1, 3, 4), points(1, 3, 4, 5, 6))
    assert sorted((r["page"], r["strategy_rank"]) for r in got.collect()) == [(1, 0), (1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (4, 3), (5, 4), (6, 5)]


def test_scopes_remove_what_they_stored(spark):
    df = spark.range(5)
    with storage.scope(spark):
        inner, kept = storage.stored(df), storage.stored(df, scoped=False)
        assert os.path.isdir(inner.stored_path)
        again = storage.replaced(inner, storage.stored(inner.selectExpr("id + 1 AS id")))
        assert not os.path.isdir(inner.stored_path) and again.count() == 5
    assert not os.path.isdir(again.stored_path) and kept.count() == 5
    storage.remove(spark, kept.stored_path)


def test_names_that_share_their_rarest_characters_alone_do_not_meet(spark, monkeypatch):
    """Names of six letters, all with q and z, their rarest: only those that are near by edit distance get a ratio."""
    import itertools

    names = ["qz" + "".join(c) for c in itertools.product("abc", repeat=4)] + [2 * c + "".join(x) for c in "de" for x in itertools.product("abc", repeat=4)]
    df = spark.createDataFrame([("b", n, i) for i, n in enumerate(names)], "book_id string, name string, seq long")
    met, keep = [], similarity.stored

    def counted(rows):
        out = keep(rows)
        if "j" in out.columns:
            met.extend((r["a"], r["b"]) for r in out.collect())
        return out

    monkeypatch.setattr(similarity, "stored", counted)
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, 0.8).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(names, 2) if similarity.sequence_ratio(a, b) > 0.8}
    assert len(met) == len(set(met)) <= 2 * len(got)


def test_long_names_and_low_thresholds_keep_every_similar_pair(spark):
    import random

    rng = random.Random(4)
    first = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice((2, 5, 9, 17, 40)))) for _ in range(40)]
    names = sorted({*first, *("".join(c for c in n if rng.random() < 0.85) or "x" for n in first)})
    df = spark.createDataFrame([("b", n, i) for i, n in enumerate(names)], "book_id string, name string, seq long")
    for threshold in (0.5, 0.7, 0.85):
        got = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, threshold).collect()}
        assert got == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if similarity.sequence_ratio(a, b) > threshold} and got
