"""Scalar functions on edge values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from catalogforge import functions as C


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", fn("v").alias("out")).orderBy("i").collect()]


CASES = {
    "slug": (
        C.slug,
        {
            "AC/DC": "acdc", "Björk": "björk", "x²": "x²", "a__b": "a__b",
            "--a  -b--": "a-b", "!!!": "unknown", None: "unknown", "": "unknown",
            "Don't": "dont", "a b c": "a-b-c", "日本 語": "日本-語", "a\x1cb": "a-b",
        },
    ),
    "ascii_slug": (C.ascii_slug, {"Don't": "don-t", "Björk!": "bj-rk-", "a_b": "a-b"}),
    "clean_artist": (
        C.clean_artist,
        {
            '"Magnetic Fields, The"': "The Magnetic Fields", "Beatles, THE": "The Beatles",
            "Casa, la": "La Casa", '"""Q"""': "Q", "Foo,The": "Foo,The", ", The": "The",
            '""': "", None: None, "  x, An ": "An x", "A, B, los": "Los A, B",
            'in "the" mid': 'in "the" mid', "The": "The", "x, Them": "x, Them",
            "x, The, A": "A x, The",
        },
    ),
    "clean_album": (
        C.clean_album,
        {'"Soundtrack, SLC Punk"': "Soundtrack, SLC Punk", ' " a " ': "a", "x, The": "x, The"},
    ),
    "clean_genre": (
        C.clean_genre,
        {'"Rock"': "Rock", "211": None, "?!": None, "": None, None: None, "!K7": "!K7",
         "ñ": None},
    ),
    "is_valid_name": (
        C.is_valid_name,
        {"?": False, "???": False, "  ": False, None: False, "?a": True, " ?? ": False,
         "? ?": True},
    ),
    "lenient_int": (
        C.lenient_int,
        {
            "7.9": 7, "-3.7": -3, " 7 ": 7, "1e3": 1000, "1d": 0, "0x10": 0, "nan": 0,
            "inf": 0, "1,000": 0, "": 0, None: 0, "+5": 5, ".5": 0, "5.": 5, "1_000": 1000,
            "1__0": 0, "_1": 0, "007": 7, "9007199254740993": 9007199254740992, "1e400": 0,
            "-0": 0, " 42": 42, "12 3": 0,
        },
    ),
    "clean_year": (
        lambda c: C.clean_year(c, 2024),
        {"1251": 1251, "999": None, "0": None, "44100": None, "": None, "2024": 2024,
         "2025": None, "1999.9": 1999, "-1999": None},
    ),
    "blank_to_null": (C.blank_to_null, {" \t": None, "": None, None: None, " a ": "a"}),
    "letter_or_hash": (
        C.letter_or_hash, {"10cc": "#", "abba": "A", "éa": "#", "Zed": "Z", "ßa": "SS"}
    ),
    "first_letter": (C.first_letter, {"10cc": "1", "abba": "A", "éa": "É"}),
    "link": (lambda c: C.link("/m", c), {"a/b": "/m/a/b", "/a": "/m/a", "//a": "/m//a"}),
    "link_closed": (lambda c: C.link("/m/", c), {"a": "/m/a", "/a": "/m/a"}),
    "split_tabs": (
        lambda c: F.array_join(C.split_tabs(c), "|"), {"a\t\tb\t": "a||b|", "": "", "x": "x"}
    ),
    "decode_lines": (
        lambda c: F.array_join(C.decode_lines(c), "|"),
        {" \r\na\rb\r\n\r\nc \n": "a|b||c", "": ""},
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_text(spark, name):
    fn, cases = CASES[name]
    got = dict(zip(cases, apply(spark, fn, list(cases)), strict=True))
    assert got == cases


def test_numbers(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first().v

    assert [one(C.minutes_seconds(F.lit(s))) for s in (0, 191, 4439, None, -5)] == [
        "0:00", "3:11", "73:59", "0:00", "-1:55",
    ]
    assert [one(C.padded(F.lit(n), 5)) for n in (7, 123456)] == ["00007", "123456"]
    assert one(C.rounded(F.lit(2.675), 2)) == round(2.675, 2)
    assert one(C.rounded(F.lit(0.125), 2)) == round(0.125, 2)
    assert one(C.rounded(F.lit(1234567.25), 1)) == round(1234567.25, 1)
    assert one(C.gigabytes(F.lit(126242772400))) == 117.57
    assert one(C.hours(F.lit(6033741))) == 1676.0
    assert one(C.hours_minutes(F.lit(6033741))) == "1676h 2m"
    assert one(C.whole_days(F.lit(43200))) == 1
    assert one(C.whole_days(F.lit(43199))) == 0
    assert one(C.with_thousands(F.lit(48304))) == "48,304"
    assert one(C.year_or_dash(F.lit(0))) == "-"
    assert one(C.year_or_dash(F.lit(1999))) == "1999"


def test_slug_is_idempotent(spark):
    values = ["Björk & the 3 x²", "--a--", "?", "Ünï çø_dé  x", "日本 語"]
    once = apply(spark, C.slug, values)
    assert apply(spark, C.slug, once) == once


def test_natural_order(spark):
    names = ["zeta", "Émile", "eve", "abba", "Abba", "élan"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(C.natural_order("n")).collect()]
    assert got == ["abba", "Abba", "élan", "Émile", "eve", "zeta"]
