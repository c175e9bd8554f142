"""Text functions on values that are hard: breaks before marks, refusals, missing values, nested names."""

import pytest
from pyspark.sql import functions as F

from formloom.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


FAMILY = "\U0001f469\u200d\U0001f469\u200d\U0001f467"


@pytest.mark.parametrize(
    "text, budget, want",
    [
        ("ab cd ef", 6, ["ab cd ", "ef"]),
        ("ab  cd\r\nef", 4, ["ab  ", "cd\r\n", "ef"]),
        ("ab \u0301cd ef", 7, ["ab \u0301cd ", "ef"]),  # a blank that a mark follows is no end
        ("ab\n\u0301cd", 4, ["ab\n", "\u0301cd"]),  # a line end is one all the same
        ("abcdefgh", 4, None),
        ("ab     c", 4, None),
        (f"{FAMILY} {FAMILY}", 6, [f"{FAMILY} ", FAMILY]),
        ("", 4, []),
        (None, 4, None),
    ],
)
def test_chunks(spark, text, budget, want):
    assert one(spark, text, lambda c: X.greedy_chunks(c, budget)) == want


def test_chunk_verdicts(spark):
    assert [one(spark, v, lambda c: X.chunk_verdict(c, 4)) for v in ("ab cd", "abcde f", "ab     c")] == [None, "unbreakable-run", "no-progress"]


def test_fill_needs_every_value(spark):
    m = F.create_map(F.lit("a"), F.lit("x"), F.lit("c"), F.lit(None).cast("string"))
    assert [one(spark, v, lambda c: X.fill(c, m)) for v in ("{{a}}!", "{{a}}{{b}}", "{{c}}", None, "")] == ["x!", None, None, None, ""]


def test_spans_and_fields(spark):
    text = "a{{x}}\U0001f600{{long_name}}{{x}}"
    assert [tuple(r) for r in one(spark, text, X.spans)] == [("x", 1, 6), ("long_name", 7, 20), ("x", 20, 25)]
    assert [tuple(r) for r in one(spark, text, X.fields)] == [("x", 2), ("long_name", 1)]
    assert one(spark, "none", X.spans) == []
    assert [one(spark, v, X.marker_verdict) for v in ("{{a}}", "{{1 a}}", "{{a}} {{", "}}", "{{constructor}}")] == [None, "illegal-name", "unclosed-marker", "unclosed-marker", "illegal-name"]


def test_small_functions(spark):
    assert len(one(spark, f"e\u0301{FAMILY}\r\nx", X.graphemes)) == 4
    assert one(spark, "e\u0301", X.nfc) == "\xe9"
    assert [one(spark, v, X.tri_state) for v in (None, "on", "true", "0", "off", "TRUE")] == [True, True, True, False, False, None]
    assert [one(spark, v, X.whole_number) for v in ("0", "9007199254740991", "9007199254740992", "-1", "1.0", "99999999999999999999")] == [0, 2**53 - 1, None, None, None, None]
    assert one(spark, "a\U0001f600", X.utf16_length) == 3
