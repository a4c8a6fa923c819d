"""Calendar-month arithmetic on month numbers (months since 1970-01)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month number of 9999-12: the end of a record that is still open.
NEVER_ENDS = (9999 - 1970) * 12 + 11


def month_number(date: Column) -> Column:
    """Months between 1970-01 and the calendar month of ``date``."""
    return (F.year(date) - 1970) * 12 + F.month(date) - 1


def month_start(number: Column) -> Column:
    """First day of a month number."""
    return F.add_months(F.lit("1970-01-01").cast("date"), number)


def first_of_month(date: Column) -> Column:
    return F.trunc(date, "MM")


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
