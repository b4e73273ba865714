import pytest
from pyspark.sql import functions as F

from learnloom.functions import text as tx
from learnloom.operators import mining, pages as pg


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (tx.normalize_concept, "　有限 状态机0，", "有限 状态机O"),
        (tx.fix_concept, " 语祛分析 l0; ", "语法分析IO"),
        (tx.fix_concept, None, ""),
        (tx.clean_definition, " a　b\n c ", "abc"),
        (tx.normalize_definition, " A　B\n c ", "a b c"),
        (tx.clean_scanned_text, "if  (x)\\n【a】；", "if (x)\n[a];"),
        (tx.clean_scanned_text_basic, "a\n\n\n\nb|0l", "a\n\nbIOi"),
        (tx.clean_book_text, "第 3 章  Ａ，b", "第3章 Ａ,b"),
        (tx.detect_intent, "什么是函数", "concept_explanation"),
        (tx.detect_intent, "hm", "general"),
        (tx.detect_teaching_intent, "举例", "example_request"),
        (tx.extract_defined_concept, "函数是指一种映射", "函数"),
        (tx.extract_defined_concept, "函数定义为映射", None),
        (tx.strip_role_labels, "x 助教: a\n助教: b\n学生: c", "a"),
    ],
)
def test_text_functions(spark, f, given, want):
    assert one(spark, given, f) == want


def test_actions(spark):
    assert one(spark, "Hello, thank you", tx.tag_actions) == ["greeting"]
    assert one(spark, "hm", tx.tag_actions) == []


def fence(text):
    import re

    code = re.compile(r"(if|for|while|switch|int|char|float|double|void|return|printf|scanf)\s*\(", re.I)
    out, inside = [], False
    lines = text.split("\n")
    for i, line in enumerate(lines):
        new = line
        if code.search(line) and not inside:
            inside, new = True, "```c\n" + line
        elif inside and not line.strip() and i + 1 < len(lines) and not code.search(lines[i + 1]):
            inside, new = False, line + "\n```"
        out.append(new)
    if inside:
        out[-1] += "\n```"
    return "\n".join(out)


@pytest.mark.parametrize("text", ["a", "if (x)\ny", "a\nfor (i)\n\nb\n\nwhile (1)", "if (a)\n\nif (b)\n \nz", "", "\n\nif (q)\n"])
def test_fences(spark, text):
    assert one(spark, text, tx.fence_code_lines) == fence(text)


def test_structure_and_sequences(spark):
    rows = [("b", 0, "第1章 开始\n1.1 甲\n1.10 丙\n1.2 乙"), ("b", 1, "第 2 章 以后\n2.1 丁\n第1章 新名")]
    pages = spark.createDataFrame(rows, "book_id string, page int, text string")
    chapters, sections = pg.book_chapters(pages), pg.book_sections(pages)
    assert {(r["chapter"], r["title"], r["page"]) for r in chapters.collect()} == {("1", "新名", 1), ("2", "以后", 1)}
    assert {(r["source"], r["target"]) for r in pg.section_sequence(sections).collect()} == {("1.1 甲", "1.2 乙"), ("1.2 乙", "1.10 丙")}
    assert [tuple(r)[1:3] for r in pg.chapter_sequence(chapters).collect()] == [("第1章 新名", "第2章 以后")]
    assert pg.chapter_includes_sections(chapters, sections).count() == 4
    spans = pg.chapter_spans(pages).orderBy("span", "page").collect()
    assert [(r["span"], r["title"]) for r in spans] == [(1, "第1章 开始"), (2, "第2章 以后"), (3, "第1章 新名")]


def test_assemble_ocr_lines(spark):
    boxes = [("b", 1, 1, 50.0, 10.0, 20.0, "two", 1000.0), ("b", 1, 2, 5.0, 12.0, 22.0, "one", 1000.0), ("b", 1, 3, 5.0, 60.0, 70.0, "three", 1000.0)]
    df = spark.createDataFrame(boxes, "book_id string, page int, box_id long, x double, y double, y_bottom double, text string, page_height double")
    assert [(r["line"], r["text"]) for r in pg.assemble_ocr_lines(df).orderBy("line").collect()] == [(0, "one two"), (1, "three")]


def test_mine_definitions_of_full_width_text(spark):
    pages = spark.createDataFrame([("b", 0, "数组是一组相同类型的数据。\n指针：保存地址的一种变量。")], "book_id string, page int, text string")
    got = {(r["concept"], r["definition"]) for r in mining.mine_definitions(pages).collect()}
    assert ("数组", "一组相同类型的数据") in got and ("指针", "保存地址的一种变量") in got


def test_mine_textbook(spark):
    text = "1.2 数组 基础\n(1)下标从零开始计数(2)短\n变量: 可以改变的量。\nif (x) {\n"
    pages = spark.createDataFrame([("b", 3, text)], "book_id string, page int, text string")
    got = {r["concept"]: r for r in mining.mine_textbook(pages).collect()}
    assert got["数组 基础"]["importance"] == 4
    assert got["数组 基础 #1"]["definition"] == "下标从零开始计数" and "数组 基础 #2" not in got
    assert got["变量"]["definition"] == "可以改变的量" and "ifstatement" in got and "数组" in got


def test_best_point(spark):
    rows = [("b", 1, 2, "c", "x" * 20, 4, 3), ("b", 2, 1, "c", "x" * 5, 5, 3)]
    points = spark.createDataFrame(rows, "book_id string, seq long, page int, concept string, definition string, importance int, difficulty int")
    assert abs(points.select(mining.point_score()).first()[0] - 13.25) < 1e-9
    assert mining.best_point_per_group(points, ["concept"]).first()["seq"] == 1


def test_line_cleaners_split_and_match_once(spark):
    """An expression inside an array function is evaluated for each line, so texts of many lines took a time of their square."""
    df = spark.createDataFrame([("a\nint x;\n\nb",)], "text string")
    for cleaner in (tx.fence_code_lines, tx.format_code_blocks):
        plan = df.select(cleaner(F.col("text"), "x").alias("text"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1 and plan.count("RLIKE") + plan.count("rlike") == 1


def test_texts_are_searched_once_for_both_groups(spark):
    """Unless the pattern looks around its match, where the match alone would not do."""
    pages = spark.createDataFrame([("b", 1, "Red is a warm colour. So is the one of fire. Blue is cold.")], "book_id string, page long, text string")
    for pattern, searches in ((r"([A-Za-z]{2,20}) is ([^.\n]{5,}?)\.", 1), (r"(?<=^|\. )(\w+) is ([^.]+)\.", 2)):
        found = mining.mine_definitions(pages, [pattern], 2, 3)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == searches
        want = [("Red", "a warm colour"), ("So", "the one of fire")] + ([("Blue", "cold")] if searches == 2 else [])
        assert [(r["concept"], r["definition"]) for r in found.orderBy("seq").collect()] == want
