"""Capture history of repeated groups."""

import pytest
from pyspark.sql import functions as F

from textsentry.functions.regex import capture_history, repeated_part

CASES = [
    (r"@(?:([a-z0-9-]+)\.)+[a-z]{2,5}", 1, "@mail.example.com", ["mail", "example"]),
    (r"([a-z]+)(?:-([a-z]+))+", 2, "one-two-three", ["two", "three"]),
    (r"(\d{2}){2,}\d", 1, "12345", ["12", "34"]),
    # A round may only take what leaves the rest whole rounds.
    (r"(?:(ab|abc)(?=[cd]|$)?)+", 1, "abcab", ["abc", "ab"]),
    (r"x(?<word>[(]a[)]|\(b\)|\Q(c)\E)*", 1, "x(a)(b)(c)", ["(a)", "(b)", "(c)"]),
    (r"(?:<((?:[a-z],)+)>)+", 1, "<a,b,><c,>", ["a,b,", "c,"]),
    (r"k(a)*", 1, "k", []),
]


@pytest.mark.parametrize("pattern, group, text, want", CASES)
def test_all_captures(spark, pattern, group, text, want):
    row = spark.range(1).select(capture_history(F.lit(text), pattern, group).alias("h")).first()
    assert row["h"] == want


def test_what_has_no_history():
    for pattern in ("(a)b", r"(a)+\1", r"\(a\)+", "[(a)]+"):
        with pytest.raises(ValueError):
            repeated_part(pattern, 1)
