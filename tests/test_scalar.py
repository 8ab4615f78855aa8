from __future__ import annotations

from datetime import datetime
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearprint.functions import scalar


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("key, expected", [
    ("politics/1990/nov/23/past.conservatives", "e8c5e312fae36c43d965a0e3da84e68d"),
    ("commentisfree/2020/oct/04/johnson-is-a-poor-prime-minister", "7d2669e5a86f5a5eb16862f691482fe3"),
    ("commentisfree/2020/oct/04/university-in-a-pandemic", "069738f52edca2125142e0952dbbfcc0"),
])
def test_article_id(spark, key, expected):
    assert one(spark, scalar.article_id(F.lit(key))) == expected


def test_api_timestamp_both_ways(spark):
    text = "2002-02-25T01:53:00Z"
    assert one(spark, scalar.parse_api_timestamp(F.lit(text))) == datetime(2002, 2, 25, 1, 53)
    assert one(spark, scalar.format_api_timestamp(F.lit("2002-02-25 01:53:00.75").cast("timestamp_ntz"))) == text
    assert one(spark, scalar.format_api_timestamp(F.lit(None).cast("timestamp_ntz"))) is None
    for bad in ("2002-02-25", "2002-13-25T01:53:00Z", ""):
        assert one(spark, scalar.parse_api_timestamp(F.lit(bad))) is None


def test_timestamps_ignore_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        # This local time does not exist in London.
        text = "2020-03-29T01:30:00Z"
        parsed = scalar.parse_api_timestamp(F.lit(text))
        assert one(spark, parsed) == datetime(2020, 3, 29, 1, 30)
        assert one(spark, scalar.format_api_timestamp(parsed)) == text
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("name", ["peter McKAY", "jean-paul o'neil", "3rd man", " élodie d'été ", "ßa"])
def test_title_case_is_that_of_python(spark, name):
    assert one(spark, scalar.title_case(F.lit(name))) == name.title().strip()


def test_title_cleanup(spark):
    raw = "CRAIG BROWN: Will these sinning saints be cancelled? | Daily Mail Online"
    assert one(spark, scalar.page_title(F.lit(raw), ": ", " | Daily Mail Online")) == "Will these sinning saints be cancelled?"
    assert one(spark, scalar.page_title(F.lit("A: B: C"), ": ", " | X")) == "C"


BASES = ["https://www.site.example", "https://www.site.example/", "http://h.example/a/b.html?x=1#top", "http://h.example/a/b/"]
LINKS = ["http://other.example/x", "//cdn.example/x", "/x/y", "x/y", "../x", "./x", "?page=2", "#part", "", "../../../x",
         "/a/../b", "a/./b/..", "mailto:x@y.example"]


@pytest.mark.parametrize("base", BASES)
def test_absolute_url_is_that_of_python(spark, base):
    df = spark.createDataFrame([(base, link) for link in LINKS], "base string, link string")
    for row in df.select("link", scalar.absolute_url("base", "link").alias("url")).collect():
        assert row.url == urljoin(base, row.link), row.link


def test_vector_literals(spark):
    assert one(spark, scalar.parse_vector(F.lit("{1.0, 0.0,2.5}"))) == [1.0, 0.0, 2.5]
    assert one(spark, scalar.parse_vector(F.lit("[0.25]"))) == [0.25]
    assert one(spark, scalar.parse_vector(F.lit("{}"))) == []


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=5))
def test_vector_literal_roundtrip(spark, values):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(scalar.parse_vector(scalar.format_vector("v"))).first()[0] == values


def test_small_text_functions(spark):
    assert one(spark, scalar.squeeze_spaces(F.lit(" a \n\t b  "))) == "a b"
    assert one(spark, scalar.strip(F.lit("  a "))) == "a"
    assert one(spark, scalar.strip_key_padding(F.lit("ab   "))) == "ab"
    assert one(spark, scalar.first_chars(F.lit("abcdef"), 3)) == "abc"
    assert one(spark, scalar.first_words(F.lit("one two  three"), 2)) == "one two"
    assert one(spark, scalar.without(F.lit("a|b|c"), "|")) == "abc"
