import pytest
from pyspark.sql import functions as F

from learnloom.operators import mining
from learnloom.plans import extraction


@pytest.mark.parametrize("blank", ["\u3000", "\u00a0"])
def test_guards_let_through_what_their_patterns_match(spark, blank):
    texts = [
        "栈是指先进后出。", f"{blank}some name：what it is。", "函数的定义是一段代码。", "所谓循环，是指重复。", "name—what it is。",
        f"#include{blank}<a.h> reads it。", "main() begins it。", f"return{blank}x; ends it。", f"int{blank}f{blank}(a) adds it。",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    checks = [F.col("text").rlike(x).alias(f"{n}{i}") for n, xs in (("p", mining.TEXTBOOK_PATTERNS), ("g", mining.TEXTBOOK_GUARDS)) for i, x in enumerate(xs)]
    found = {r["text"]: r for r in rows.select("text", *checks).collect()}
    for i, t in enumerate(texts):
        assert found[t][f"p{i}"] and found[t][f"g{i}"], t


def test_function_after_a_wide_space_is_mined(spark):
    text = "int　add(a, b) adds two numbers。"
    pages = spark.createDataFrame([("b", 1, text)], "book_id string, page long, text string")
    assert any("add" in r["concept"] for r in mining.mine_textbook(pages, ["token"]).collect())
    lost = extraction.parse_point_responses(pages.withColumnRenamed("text", "response"))
    assert any("add" in r["concept"] for r in lost.collect())
