"""Property tests for the exact-arithmetic helpers against Python's Decimal."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrina.functions.common import avg_cents, cents
from vitrina.operators.catalog import half_up_1dp
from vitrina.operators.export import abbreviate

money_lists = st.lists(st.integers(min_value=0, max_value=10**11), min_size=1, max_size=12)


@settings(max_examples=25, deadline=None)
@given(money_lists)
def test_avg_cents_is_exact_half_up(spark, values):
    amounts = [Decimal(v) / 100 for v in values]
    df = spark.createDataFrame([(a,) for a in amounts], "x decimal(12,2)")
    got = df.agg(avg_cents(F.sum(cents("x")), F.count("x")).alias("a")).collect()[0].a
    want = (sum(amounts) / len(amounts)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    assert got == float(want)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=1, max_value=5), min_size=1, max_size=30))
def test_rating_average_is_exact_half_up(spark, ratings):
    df = spark.createDataFrame([(r,) for r in ratings], "r int")
    got = df.agg(half_up_1dp(F.sum("r"), F.count("r")).alias("a")).collect()[0].a
    want = (Decimal(sum(ratings)) / len(ratings)).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)
    assert got == float(want)


def _abbrev_reference(x: Decimal) -> str:
    for threshold, suffix in [(10**12, "T"), (10**9, "B"), (10**6, "M"), (10**3, "K")]:
        if x >= threshold:
            s = str((x / threshold).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))
            return (s[:-2] if s.endswith(".0") else s) + suffix
    return str(x.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


@settings(max_examples=25, deadline=None)
@given(st.integers(min_value=0, max_value=10**16))
def test_abbreviate_matches_decimal_rule(spark, c):
    x = Decimal(c) / 100
    df = spark.createDataFrame([(x,)], "x decimal(20,2)")
    assert df.select(abbreviate(F.col("x")).alias("f")).collect()[0].f == _abbrev_reference(x)
