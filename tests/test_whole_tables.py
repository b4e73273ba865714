"""Queries that SQL does not express, over the whole smallest tables, against plain definitions."""

import os
import re

import pytest

from learnloom.operators import similarity
from learnloom.queries import bindings as b, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def points(spark):
    return sorted(map(tuple, b.points(spark, SF).select("book_id", "seq", "concept", "importance").collect()), key=lambda r: r[1])


def test_near_duplicates_are_all_pairs(spark, points):
    want = set()
    for book in {p[0] for p in points}:
        firsts = {}
        for _, seq, name, _ in (p for p in points if p[0] == book):
            firsts.setdefault(name, seq)
        names = sorted((s, n) for n, s in firsts.items())
        want |= {(book, i, j, round(similarity.sequence_ratio(a, c), 6)) for i, a in names for j, c in names if i < j and similarity.sequence_ratio(a, c) > 0.8}
    got = queries()["near_duplicate_concepts"](spark, SF).collect()
    assert {(r["book_id"], r["i"], r["j"], r["ratio"]) for r in got} == want and len(got) == len(want)


def test_groups_follow_the_sequential_definition(spark, points):
    got = {(r["book_id"], r["seq"]): r["leader"] for r in queries()["group_similar_concepts"](spark, SF).collect()}
    for book in {p[0] for p in points}:
        own, firsts = [p for p in points if p[0] == book], {}
        for _, seq, name, _ in own:
            firsts.setdefault(name, seq)
        leader = similarity.brute_force_groups((s, n) for n, s in firsts.items())
        assert all(got[book, seq] == leader[firsts[name]] for _, seq, name, _ in own)


def test_requests_cover_every_page(spark, points):
    pages = {(r["book_id"], r["page"]): r["text"] or "" for r in b.pages(spark, SF).collect()}
    terms = {r["term"] for r in b.vocabulary(spark, SF).collect()}
    longest, want = max(map(len, terms)), set()
    for (book, page), text in pages.items():
        for part in range(max(1, -(-len(text) // 1500))):
            want.add((book, page, "direct", part, "List concepts and definitions as JSON.\n" + text[part * 1500 : part * 1500 + 1500]))
        part = 0
        for chunk in range(-(-len(text) // 3000)):
            shown = text[chunk * 3000 : chunk * 3000 + 3000 + longest - 1]
            met = sorted(t for t in terms if t in shown.lower() and any(m.start() < 3000 for m in re.finditer(re.escape(t), shown.lower())))
            for at in range(0, len(met), 5):
                want.add((book, page, "vocabulary", part, "Define as JSON: " + ", ".join(met[at : at + 5]) + "\n" + shown))
                part += 1
        long = [p for p in text.split("\n") if len(p.strip()) > 150]
        for part, paragraph in enumerate(long[:3] if len(long) > 1 else []):
            want.add((book, page, "paragraph", part, "List concepts and definitions as JSON.\n" + paragraph))
    for book in {p[0] for p in points}:
        best = sorted((p for p in points if p[0] == book), key=lambda p: (-p[3], p[1]))[:25]
        want.add((book, None, "relations", 0, "Relate these concepts as JSON.\n" + ", ".join(p[2] for p in best)))
    got = [tuple(r) for r in queries()["extraction_requests"](spark, SF).select("book_id", "page", "strategy", "part", "prompt").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_plain_documents_only_have_characters_swapped(spark):
    cleaned = {r["doc_id"]: r["text"] for r in queries()["clean_book_text"](spark, SF).collect()}
    plain = 0
    for r in b.table(spark, SF, "documents").collect():
        text = r["text"]
        if text is None or re.search(r"[0-9]|\n{3}|[．，；：]|(?i:if|for|while|switch|int|char|float|double|void|return|printf|scanf)\s*\(", text):
            continue
        plain += 1
        assert cleaned[r["doc_id"]] == text.translate(str.maketrans("Ol", "0I"))
    assert plain > 20 and len(cleaned) == 200


def test_textbook_points_hold_key_terms_in_context(spark):
    from learnloom.queries.corpus import TERMS

    got = queries()["mine_textbook"](spark, SF).collect()
    found = {(r["book_id"], r["page"], r["concept"]) for r in got}
    for r in b.pages(spark, SF).collect():
        text = r["text"] or ""
        for term in TERMS:
            assert ((r["book_id"], r["page"], term) in found) or term not in text
    assert len({(r["page"], r["concept"], r["seq"]) for r in got}) == len(got)
