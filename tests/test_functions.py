from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfseek.functions import display as D
from shelfseek.functions import numbers as N
from shelfseek.functions import semistructured as S
from shelfseek.functions import text as T
from shelfseek.operators.upsert import apply_defaults, load_time


def values(spark, expression, items, kind="string"):
    rows = spark.createDataFrame([(i, item) for i, item in enumerate(items)], f"i int, c {kind}").repartition(3)
    got = rows.select("i", expression(F.col("c")).alias("x")).collect()
    return [row["x"] for row in sorted(got, key=lambda row: row["i"])]


BLANK = [None, "", "   ", "\t", " ", "\u001c", " x "]


def test_blank_rules(spark):
    assert values(spark, T.has_text_sql, BLANK) == [False, False, False, True, True, True, True]
    assert values(spark, T.has_text, BLANK) == [False, False, False, False, False, False, True]


def test_strip_is_python_strip(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = [c + "a b" + c for c in spaces] + ["​a​", "﻿a"]
    assert values(spark, T.strip, texts) == [text.strip() for text in texts]


def test_squash_class_is_python_space(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert values(spark, T.squash, [f"a{c}{c}b" for c in spaces]) == ["a b"] * len(spaces)


def test_clean_or(spark):
    assert values(spark, lambda c: T.clean_or(c, "none"), BLANK) == ["none"] * 6 + ["x"]
    assert values(spark, T.clean_or, BLANK) == [None] * 6 + ["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("$12.99", None), ("1_000", 1000.0), (" 12.5 ", 12.5), ("nan", None), ("inf", None), ("1.0d", None),
        ("1e3", 1000.0), ("", None), ("0", None), ("-0.0", None), (".5", 0.5), ("5.", 5.0), ("1__0", None),
        ("1e999", None), ("0x1F", None), (None, None), ("12.7", 12.7), ("+3", 3.0),
    ],
)
def test_price(spark, text, expected):
    assert values(spark, N.price, [text]) == [expected]


def test_count(spark):
    assert values(spark, N.count, ["12.7", "-3.9", "0", "nan", "inf", "1e400", "7", "x"]) == [
        12, -3, None, None, None, None, 7, None,
    ]


def test_sanitize(spark):
    rows = [(1, float("nan"), Decimal("12.34")), (2, float("inf"), None), (3, float("-inf"), Decimal("0")), (4, 1.5, None)]
    df = spark.createDataFrame(rows, "i int, x double, d decimal(8,2)")
    clean = N.sanitize(df)
    assert [tuple(r) for r in clean.orderBy("i").collect()] == [(1, None, 12.34), (2, None, None), (3, None, 0.0), (4, 1.5, None)]
    assert clean.schema["d"].dataType.simpleString() == "double"


def test_nan_price(spark):
    assert values(spark, N.nan_to_null, [math.nan, 1.0, None], "double") == [None, 1.0, None]


def test_clean_description(spark):
    cases = {
        None: "",
        "": "",
        "AMAZON.com rocks Product Description": "rocks",
        "it'S 'Best": "it S  Best",
        "['a'  'b']": "a b",
        "Product Descriptions": "Product Descriptions",
        "From the Manufacturer\n  x ": "x",
    }
    assert values(spark, T.clean_description, list(cases)) == list(cases.values())


def test_clean_text(spark):
    cases = {
        None: "",
        "[a, 'b'] costs 1,000!": "a , b costs 1,000 !",
        r"line\nnext\tcell": "line next cell",
        "You cannot stop. Go...": "You can not stop . Go ...",
        "I gotta go (now)": "I got ta go ( now )",
        "Wanna see lemme": "Wan na see lem me",
    }
    assert values(spark, T.clean_text, list(cases)) == list(cases.values())


def test_display_text(spark):
    cases = {None: "", "": "", "['a b' 'c', 'd']": "a b c', 'd", "'x'": "x", "a ﻿ b": "a b"}
    assert values(spark, T.clean_display_text, list(cases)) == list(cases.values())


def test_sentences(spark):
    cases = ["One. Two!  Three? four", "", "  ", "No end", "a.b c. d"]
    assert values(spark, T.sentences, cases) == [
        ["One.", "Two!", "Three?", "four"], [], [], ["No end"], ["a.b c.", "d"],
    ]


def test_first_image(spark):
    numpy = "{'hi_res': array(['h'], dtype=object), 'large': array([], dtype=object), 'thumb': array(['t'], dtype=object)}"
    cases = {
        numpy: "h",
        '{"large": ["l"]}': "l",
        '{"large": [""], "thumb": ["t"]}': "t",
        '{"large": ["l"]}{': None,
        "{'large': [None]}": None,
        "": None,
        None: None,
        "[]": None,
    }
    assert values(spark, S.first_image, list(cases)) == list(cases.values())


def test_details(spark):
    cases = {
        "{'Brand': 'X', 'Wireless': True, 'Color': None}": {"Brand": "X", "Wireless": "true", "Color": None},
        "{'a': 'True Wireless'}": {"a": "true Wireless"},
        "{'a': {'b': 1}}": {"a": '{"b":1}'},
        "{'a': 'it's'}": None,
        "{'a': 1} x": None,
    }
    assert values(spark, S.details_map, list(cases)) == list(cases.values())
    assert values(spark, S.details_fallback, ["{'a': 'it's  b'}"]) == ["'a': 'it's b'"]


def test_responses(spark):
    body = (
        '{"candidates":[{"content":{"parts":[{"text":"hi"}]},"groundingMetadata":{"groundingAttributions":'
        '[{"web":{"uri":"u","title":"t"}},{"web":{"uri":"u"}},{}]}}]}'
    )
    items = [body, '{"candidates":[]}', "{", None]
    assert values(spark, S.response_text, items) == ["hi", "", "", ""]
    assert [[tuple(s) for s in sources] for sources in values(spark, S.response_sources, items)] == [[("u", "t")], [], [], []]


def test_display(spark):
    assert values(spark, D.price_label, [12.5, 0.0, None], "double") == ["$12.50", None, None]
    assert values(spark, D.star_bar, [4.5, 0.2, 5.0], "double") == ["★★★★★", "☆☆☆☆☆", "★★★★★"]
    assert values(spark, D.reviews_label, [1234567, 0], "bigint") == ["1,234,567 reviews", None]
    assert values(spark, D.store_label, ["", None, "S"]) == ["Unknown Store", "Unknown Store", "S"]


def test_defaults_and_time(spark):
    df = spark.createDataFrame([(1, None), (2, "admin")], "i int, role string")
    assert [r["role"] for r in apply_defaults(df, {"role": "enduser"}).orderBy("i").collect()] == ["enduser", "admin"]
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    stamped = df.select(load_time(at).alias("t"), load_time().alias("now"))
    assert stamped.first()["t"] == at
    assert [f.dataType.simpleString() for f in stamped.schema] == ["timestamp_ntz", "timestamp_ntz"]
