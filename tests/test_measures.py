"""Rounding against exact decimal arithmetic, and month arithmetic."""

from __future__ import annotations

from datetime import date
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanledger.functions.measures import (
    from_hundredths,
    hundredths,
    mean_half_up,
    pct,
    rank_desc,
    ratio_half_up,
    share_of_total,
)
from spanledger.functions.months import month_number, month_start


def exact(num: int, den: int, places: int) -> float | None:
    if den == 0:
        return None
    with localcontext() as context:
        context.prec = 120
        return float((Decimal(num) / Decimal(den)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


pairs = st.tuples(st.integers(-(10**15), 10**15), st.integers(0, 10**9))


@settings(max_examples=5, deadline=None)
@given(rows=st.lists(pairs, min_size=40, max_size=80))
def test_ratio_rounds_half_away_from_zero(spark, rows):
    halves = [(1, 8), (1, 200), (3, 200), (-1, 8), (5, 1000), (0, 3), (1, 0), (125, 1000)]
    rows = halves + rows
    columns = [ratio_half_up(F.col("n"), F.col("d"), p).alias(f"p{p}") for p in (0, 1, 2, 3)]
    got = spark.createDataFrame(rows, "n long, d long").select("n", "d", *columns).collect()
    for row in got:
        for places in (0, 1, 2, 3):
            assert row[f"p{places}"] == exact(row.n, row.d, places), (row.n, row.d, places)


def test_ratio_of_nulls_and_percentages(spark):
    rows = spark.createDataFrame([(None, 3), (1, 3), (2, 3), (1, 0)], "n long, d long")
    assert [r[0] for r in rows.select(pct(F.col("n"), F.col("d"))).collect()] == [None, 33.3, 66.7, None]


def test_mean_of_decimals(spark):
    rows = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),), (None,)], "x decimal(10,2)")
    units = hundredths(rows, "x")
    mean = mean_half_up(F.sum(units), F.count(units), 2, scale=2)
    assert tuple(rows.agg(mean, from_hundredths(F.sum(units))).first()) == (0.02, Decimal("0.03"))


def test_hundredths_keep_sign_and_size(spark):
    amounts = [Decimal("-0.01"), Decimal("9999999999.99"), Decimal("-9999999999.99")]
    rows = spark.createDataFrame([(a,) for a in amounts], "x decimal(12,2)")
    back = rows.select(from_hundredths(hundredths(rows, "x")))
    assert [r[0] for r in back.collect()] == amounts


@pytest.mark.parametrize("kind", ["decimal(12,3)", "double"])
def test_amounts_finer_than_hundredths_are_refused(spark, kind):
    with pytest.raises(TypeError, match="at most two places"):
        hundredths(spark.createDataFrame([], f"x {kind}"), "x")


def test_shares_and_ranks_leave_gaps_after_ties(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 5), ("c", 2)], "k string, n long")
    got = rows.select("k", share_of_total(F.col("n")), rank_desc(F.col("n"))).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 41.7, 1), ("b", 41.7, 1), ("c", 16.7, 3)]


@pytest.mark.parametrize("day", ["1969-12-31", "1970-01-01", "2023-02-28", "2024-02-29", "9999-12-31"])
def test_month_numbers_go_back_and_forth(spark, day):
    wanted = date.fromisoformat(day).replace(day=1)
    column = F.lit(day).cast("date")
    assert spark.range(1).select(month_start(month_number(column))).first()[0] == wanted
