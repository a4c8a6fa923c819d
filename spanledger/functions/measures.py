"""Rounded ratios, shares and ranks.

Ratios are rounded half away from zero on exact integers, which is what a SQL
NUMERIC gives.  Rounding a binary double instead moves some half-way cases.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

_WHOLE = DecimalType(38, 0)


def ratio_half_up(num: Column, den: Column, places: int) -> Column:
    """``num / den`` to ``places`` decimals; both integral; NULL when ``den`` is 0."""
    step = 10**places
    whole, parts = num.cast(_WHOLE), F.nullif(den.cast(_WHOLE), F.lit(0).cast(_WHOLE))
    doubled = F.abs(whole) * F.lit(2 * step) + parts
    units = F.call_function("div", doubled, parts * F.lit(2))
    return F.when(whole < 0, -units).otherwise(units) / F.lit(float(step))


def pct(num: Column, den: Column, places: int = 1) -> Column:
    """Percentage of ``den``; NULL when ``den`` is 0."""
    return ratio_half_up(num.cast(_WHOLE) * F.lit(100), den, places)


def hundredths(df: DataFrame, name: str) -> Column:
    """A column of at most two decimals as whole hundredths.

    Sums of these run on longs; sums of decimals wider than 8 digits do not, and
    are several times slower.  A finer column is refused rather than cut.
    """
    kind = df.schema[name].dataType
    if not isinstance(kind, IntegralType) and not (isinstance(kind, DecimalType) and kind.scale <= 2):
        raise TypeError(f"{name} must be a decimal of at most two places, not {kind.simpleString()}")
    return (F.col(name) * 100).cast("bigint")


def from_hundredths(units: Column) -> Column:
    """Whole hundredths as a decimal of two places."""
    return units.cast("decimal(20,0)") * F.lit(Decimal("0.01"))


def mean_half_up(total: Column, count: Column, places: int, scale: int = 0) -> Column:
    """Mean from a row count and a sum in units of ``10 ** -scale``."""
    return ratio_half_up(total, count * F.lit(10**scale), places)


def share_of_total(count: Column, places: int = 1) -> Column:
    """Share of the sum over all rows; for grouped rows only, as it gathers them."""
    return pct(count, F.sum(count).over(Window.partitionBy()), places)


def rank_desc(measure: Column) -> Column:
    """Competition rank over grouped rows, largest first."""
    return F.rank().over(Window.orderBy(measure.desc())).cast("bigint")


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_where(condition: Column, value: Column) -> Column:
    """Sum over the rows that meet ``condition``; NULL when none does."""
    return F.sum(F.when(condition, value))
