"""The book cleaner with its default patterns, on texts whose clean form was worked out by hand."""

from learnloom.queries import corpus

CLEANED = [
    # Contents lines lose their dots; then a page number, a line break and a section number are one split number.
    ("1.2 Loops......17\n1.3 Arrays....20", "1.2 Loops 17.1.3 Arrays 20"),
    ("4.1 Names.....9", "4.1 Names 9"),
    # Split section numbers are put together, headings lose spaces.
    ("1 . 2 . 3   Pointers\ntext", "1.2.3 Pointers\ntext"),
    ("3. 4 .5 Names 6", "3.4.5 Names 6"),
    ("第 2 章  Loops\n第3 节  For", "第2章 Loops\n第3节 For"),
    # Swaps of characters, and full-width marks.
    ("no numbers, OlO", "no numbers, 0I0"),
    ("甲，乙；丙：丁．", "甲,乙;丙:丁."),
    ("a\n\n\n\nb 1 2", "a\n\nb 1 2"),
    ("text www.ityinhu.com  \nmore", "text \nmore"),
    # A fence opens before code and closes at a blank line before text, or at the end.
    ("for (i = 0; i < 3; i++)\n  printf(x)\n\nplain 2.5 text", "```c\nfor (i = 0; i < 3; i++)\n  printf(x)\n\n```\npIain 2.5 text"),
    ("if (x)\n\nif (y)", "```c\nif (x)\n\nif (y)\n```"),
    ("", ""),
]


def test_all_documents_are_cleaned_with_the_default_patterns(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANED)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in corpus.clean_book_text(spark, str(tmp_path)).collect()}
    assert got == {i: t for i, (_, t) in enumerate(CLEANED)}
