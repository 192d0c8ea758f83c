"""Money-parser dialects P1..P5 against hand-derived vectors (FIXTURES.md §5)."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nomina.functions import money as M

# input, P1 auto, P2 cl, P3 validator, P4 extractor, P5 multidot (None = unparsable)
VECTORS = [
    ("7.738.744", 7738744, 7738744, 7738744, None, 7738744),
    ("659.267", 659267, 659267, 659.267, 659.267, 659.267),
    ("1.234.567,89", 1234567.89, 1234567.89, 1234567.89, 1234567.89, 1234567.89),
    ("1,234,567.89", 1234567.89, None, None, None, None),
    ("123.45", 123.45, 12345, 12345, 12345, 123.45),
    ("1,234", 1234, 1.234, None, None, None),
    ("1,23", 1.23, 1.23, None, None, None),
    ("683261.0", 683261, 6832610, 6832610, 6832610, 683261),
    ("-5", 5, -5, 5, 5, 5),
    (".", None, None, None, None, None),
    (",", None, None, None, None, None),
    ("", None, None, None, None, None),
    ("abc", None, None, None, None, None),
]
DIALECTS = ["auto", "cl", "validator", "extractor", "multidot"]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(v[0],) for v in VECTORS], "t string")
    cols = [M.parse_money("t", d).alias(d) for d in DIALECTS]
    return {r["t"]: r for r in df.select("t", *cols).collect()}


@pytest.mark.parametrize("vec", VECTORS, ids=[v[0] or "empty" for v in VECTORS])
def test_vectors(parsed, vec):
    row = parsed[vec[0]]
    for dialect, expected in zip(DIALECTS, vec[1:]):
        got = row[dialect]
        if expected is None:
            assert got is None, (dialect, vec[0], got)
        else:
            assert got is not None and math.isclose(got, expected, rel_tol=1e-12), (dialect, vec[0], got)


@settings(max_examples=40, deadline=None)
@given(st.integers(min_value=1000, max_value=99_999_999), st.integers(min_value=0, max_value=99))
def test_auto_reads_every_locale_rendering(spark, whole, cents):
    """P1 recovers the amount from Chilean, US, plain and comma-decimal renderings."""
    x = whole + cents / 100
    us = f"{x:,.2f}"
    cl = us.replace(",", "_").replace(".", ",").replace("_", ".")
    variants = [us, cl, f"{x:.2f}", f"{x:.2f}".replace(".", ","), f"$ {us}"]
    df = spark.createDataFrame([(v,) for v in variants], "t string")
    for r in df.select(M.money_auto("t").alias("v")).collect():
        assert math.isclose(r["v"], x, rel_tol=1e-12)
