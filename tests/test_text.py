import re
from urllib.parse import quote

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions.text import (
    WHITESPACE,
    decode_entities,
    normalize_whitespace,
    page_url,
    sanitize_filename,
    squeeze_blank_lines,
    strip,
)


def run(spark, values, column):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in sorted(frame.select("i", column.alias("y")).collect())]


def test_whitespace_is_that_of_python(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    assert {c for c in chars if c.isspace()} == set(WHITESPACE)
    values = [f"a{c}{c}b{c}" for c in chars]
    assert run(spark, values, normalize_whitespace(F.col("x"))) == [re.sub(r"\s+", " ", v).strip() for v in values]
    assert run(spark, values, strip(F.col("x"))) == [v.strip() for v in values]


def test_normalize_null_is_empty(spark):
    assert run(spark, [None, "", " \n "], normalize_whitespace(F.col("x"))) == ["", "", ""]


def test_page_urls(spark):
    base = "https://en.wikipedia.org/"
    cases = {
        "John M. Burns (sailor)": base + "wiki/John_M._Burns_%28sailor%29",
        "Richy Ahmed": base + "wiki/Richy_Ahmed",
        "C++": base + "wiki/C%2B%2B",
        "~x*!'()": base + "wiki/~x%2A%21%27%28%29",
        "AC/DC: x?#": base + "wiki/AC%2FDC%3A_x%3F%23",
        ".": base + "wiki/",
        "..": base,
        "": base + "wiki/",
    }
    assert run(spark, list(cases), page_url(F.col("x"))) == list(cases.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0")), min_size=40))
def test_page_url_quotes_like_the_standard_library(spark, titles):
    titles = [t for t in titles if t not in (".", "..")]
    expected = ["https://en.wikipedia.org/wiki/" + quote(t.replace(" ", "_"), safe="") for t in titles]
    assert run(spark, titles, page_url(F.col("x"))) == expected


def test_file_names(spark):
    cases = {"A/B: c - d": "AB-c-d", "  x  ": "x", "é_1--2": "é_1-2", "???": ""}
    assert run(spark, list(cases), sanitize_filename(F.col("x"))) == list(cases.values())


def test_blank_lines(spark):
    cases = {"a  \nb": "a\nb", "a\n\n\n\nb": "a\nb", " x\n": "x"}
    assert run(spark, list(cases), squeeze_blank_lines(F.col("x"))) == list(cases.values())


def test_entities(spark):
    cases = {
        "a &amp;lt; b": "a &lt; b",
        "&copy;&nbsp;&notin;": "©\xa0∉",
        "&#150;&#x41;&#233;&#129;": "–Aé\x81",
        "&#x1F600;": "😀",
        "&#xD800;&#99999999999;&#xFFFFFFFFF;": "���",
        "AT&T &unknown; & &;": "AT&T &unknown & &;",
        "&amp": "&",
        "plain": "plain",
    }
    assert run(spark, list(cases), decode_entities("x")) == list(cases.values())
