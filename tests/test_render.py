import math

import pytest
from pyspark.sql import functions as F

from shopcast.functions import render, replies


def reference_text(value, kind):
    """Python's own formatting of a value."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "N/A"
    return {
        "percent": lambda: f"{value:.1%}",
        "integer": lambda: f"{int(value):,}",
        "float": lambda: f"{value:.2f}",
        "string": lambda: str(value),
        "binary": lambda: "Yes" if value else "No",
    }[kind]()


VALUES = [None, math.nan, 0.0, -0.04, 0.125, 0.375, 2.675, 1234567.891, 12345678.9, 1e16, 0.5, -1.5,
          0.0001234, 1.5e-7, 1234567890123.4, 1e22, 100.0]


@pytest.mark.parametrize("kind", ["percent", "integer", "float", "string", "binary"])
def test_format_value_matches_python(spark, kind):
    # From about 2**53 / 100 on a double has more exact digits than the JVM prints.
    values = [v for v in VALUES if v is None or kind == "string" or math.isnan(v) or abs(v) < 1e17]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.select("i", render.format_value(F.col("v"), kind, "double").alias("t")).collect()
    for row in got:
        assert row["t"] == reference_text(values[row["i"]], kind)


def test_format_value_of_text_and_booleans(spark):
    df = spark.createDataFrame([("", True), ("a", False), (None, None)], "s string, b boolean")
    rows = df.select(
        render.format_value(F.col("s"), "string", "string").alias("s"),
        render.format_value(F.col("s"), "binary", "string").alias("sb"),
        render.format_value(F.col("b"), "binary", "boolean").alias("b"),
        render.format_value(F.col("b"), "string", "boolean").alias("bs"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("", "No", "Yes", "True"), ("a", "Yes", "No", "False"), ("N/A", "N/A", "N/A", "N/A")
    ]


def test_whole_and_bare_numbers(spark):
    df = spark.createDataFrame([(1234.5, "AUTOMOBILE"), (1235.5, "x"), (2.0, None)], "v double, s string")
    rows = df.select(
        render.whole_number_text(F.col("v"), "double").alias("w"),
        render.bare_number_text(F.col("v"), "double").alias("b"),
        render.whole_number_text(F.col("s"), "string", {"AUTOMOBILE": "cars"}).alias("s"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("1,234", "1234.50", "cars"), ("1,236", "1235.50", "x"), ("2", "2", "N/A")
    ]


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_confidence(spark):
    texts = ["85% of 120", "200", "none", "10 and 99", "99999999999999999999", ""]
    assert column(spark, texts, replies.confidence_number) == [85, 0, 0, 99, 0, 0]


def test_brands(spark):
    cleaned = column(spark, ["{'brand': 'brand1, brand2'}."], replies.clean_brands)
    assert cleaned == ["1, 2."]
    assert column(spark, ["a, b,\n c.", ","], replies.brand_list) == [["a", "b", "c"], []]


def test_class_codecs(spark):
    assert column(spark, ["1", "0", "10", "x"], replies.class_text) == ["accept", "refuse", "accept", None]
    assert column(spark, ["I accept", "refused", "?"], replies.class_number) == [1, 0, None]


def loose(text, task="cls"):
    """The same cuts written with Python slices."""
    import re

    start = max(text.find("answer"), 0)
    if text.find("response") != -1 and start != 0:
        start = text.find("response")
    conf, reason = text.find("confidence"), text.find("reason")
    answer = text[start:conf]
    label = "1" if "accept" in answer else "0" if "refuse" in answer else ""
    numbers = [int(n) for n in re.findall(r"\d+", text[conf:reason]) if int(n) <= 100]
    return label, max(numbers, default=0), text[reason:].replace("<|eot_id|>", "")


def test_loose_reply_follows_slices(spark):
    texts = [
        "answer: accept, confidence: 85%, reason: likes it<|eot_id|>",
        "the answer: refuse, confidence: 200 reason",
        "a response with answer: accept confidence 7 and 9 reason: x",
        "accept",
        "I refuse to answer",
        "reason: none, confidence: 5, answer: accept",
        "confidence 9",
    ]
    got = column(spark, texts, lambda t: replies.loose_reply(t, "cls"))
    assert [tuple(g) for g in got] == [loose(t) for t in texts]


def test_reply_fields_never_lose_a_row(spark):
    texts = [
        "Sure: {'answer': 'accept', 'confidence': '85%', 'reason': 'fits'}",
        '{"answer": "refuse", "confidence": 40, "reason": "no"}',
        "{answer: accept; confidence: 30; reason: broken",
        "nothing here",
    ]
    got = column(spark, texts, lambda t: replies.reply_fields(t, "cls"))
    assert [(g["answer"], round(g["confidence"], 2)) for g in got] == [
        ("1", 0.85), ("0", 0.4), ("1", 0.3), ("", 0.0)
    ]


def test_profile_body(spark):
    texts = ["Customer Profile:\nA: b", "no mark: kept", "profile: one profile: two"]
    assert column(spark, texts, replies.profile_body) == ["A: b", "no mark: kept", " one profile: two"]


def test_strip_label_sentences(spark):
    name = "Flag (10k or more)"
    got = column(
        spark, [f"Age is 3. {name} is 1. Sum is 2. "], lambda t: replies.strip_label_sentences(t, [name])
    )
    assert got == ["Age is 3.  Sum is 2. "]


def test_map_items(spark):
    assert column(spark, ["a, b, z."], lambda t: replies.map_items(t, {"a": "Toys", "b": "Pets"})) == [
        "Toys, Pets, z"
    ]
