from learnloom.plans import extraction


def test_requests_hold_the_whole_text_and_the_terms_they_ask_for(spark):
    text = "x" * 2996 + "recursion" + "y" * 2000 + "pointer" + "z" * 3000 + "Recursion" + "w" * 50
    pages = spark.createDataFrame([("b", 1, text), ("b", 2, "short loop")], "book_id string, page long, text string")
    words = spark.createDataFrame([("d", t) for t in ("recursion", "pointer", "loop")], "domain string, term string")
    points = spark.createDataFrame([("b", 1, 1, "c", "d", 3, 3)], "book_id string, seq long, page long, concept string, definition string, importance int, difficulty int")
    rows = extraction.extraction_requests(pages, points, words).collect()
    direct = sorted((r["part"], r["prompt"].split("\n", 1)[1]) for r in rows if r["strategy"] == "direct" and r["page"] == 1)
    assert "".join(t for _, t in direct) == text and all(len(t) <= 1500 for _, t in direct)
    asked = sorted((r["page"], r["part"], *r["prompt"].split("\n", 1)) for r in rows if r["strategy"] == "vocabulary")
    assert [x[:3] for x in asked] == [(1, 0, "Define as JSON: recursion"), (1, 1, "Define as JSON: pointer"), (1, 2, "Define as JSON: recursion"), (2, 0, "Define as JSON: loop")]
    assert all(t in x[3].lower() for x in asked for t in x[2].removeprefix("Define as JSON: ").split(", "))
