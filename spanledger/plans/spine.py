"""Calendar-month spine and the row-level "open in month" relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.months import first_of_month, month_label, month_number, month_start


def _date_range(df: DataFrame, low: Column | None, high: Column) -> DataFrame:
    low = F.lit(None).cast("date") if low is None else low
    return df.agg(low.alias("low"), high.alias("high"))


def _months(ranges: DataFrame, buffer_months: int = 0) -> DataFrame:
    bounds = ranges.agg(
        first_of_month(F.min("low")).alias("first"),
        F.add_months(first_of_month(F.max("high")), buffer_months).alias("last"),
    )
    return (
        bounds.filter(F.col("first") <= F.col("last"))
        .select(F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month_start"))
        .select(
            "month_start",
            F.last_day("month_start").alias("month_end"),
            month_label(F.col("month_start")).alias("month_label"),
        )
    )


def calendar_month_spine(
    accounts: DataFrame,
    subscriptions: DataFrame,
    usage: DataFrame | None = None,
    churn: DataFrame | None = None,
    buffer_months: int = 3,
) -> DataFrame:
    """One row per month from the first signup or start to the last date plus a buffer.

    Each table contributes one pre-aggregated row.  An operator that stops at
    the last signup or start can leave out ``usage`` and ``churn``: they only
    move the far end, and leaving them out saves the scan of their dates.
    """
    ranges = [
        _date_range(accounts, F.min("signup_date"), F.max("signup_date")),
        _date_range(
            subscriptions, F.min("start_date"), F.greatest(F.max("start_date"), F.max("end_date"))
        ),
    ]
    if usage is not None:
        ranges.append(_date_range(usage, None, F.max("usage_date")))
    if churn is not None:
        ranges.append(_date_range(churn, None, F.max("churn_date")))
    return _months(reduce(DataFrame.unionByName, ranges), buffer_months)


def signup_months(accounts: DataFrame) -> DataFrame:
    """The months from the first to the latest signup, in spine columns."""
    return _months(_date_range(accounts, F.min("signup_date"), F.max("signup_date")))


def spine_validate(spine: DataFrame) -> DataFrame:
    """First and last month, number of months and of repeated months."""
    return spine.agg(
        F.min("month_start").alias("spine_starts"),
        F.max("month_start").alias("spine_ends"),
        F.count("*").alias("total_months"),
        (F.count("*") - F.countDistinct("month_start")).alias("duplicate_months"),
    )


def last_spine_month(spine: DataFrame) -> Column:
    """Month number of the end of the spine, as a scalar subquery."""
    return spine.agg(month_number(F.max("month_start"))).scalar()


def first_spine_month(spine: DataFrame) -> Column:
    """Month number of the start of the spine, as a scalar subquery."""
    return spine.agg(month_number(F.min("month_start"))).scalar()


def last_start_month(subscriptions: DataFrame) -> Column:
    """Month number of the latest subscription start, as a scalar subquery."""
    return subscriptions.agg(month_number(F.max("start_date"))).scalar()


def open_month_records(subscriptions: DataFrame, spine: DataFrame) -> DataFrame:
    """Every subscription record once per spine month in which it is open.

    A record is open from the month of its start to the month of its end, or to
    the end of the spine.  Its months, bounded by the spine's first and last, are
    kept where the spine has them, which replaces an interval-overlap join.  The
    spine enters as one array by month number, from its first month to its last:
    the month's date where the spine has it, else NULL, so a record's month is one
    lookup.  The aggregating operators do not use this relation: it has one row
    per record and month, and ``plans.steps`` gives the same totals without it.
    """
    numbers = spine.agg(F.collect_set(month_number(F.col("month_start"))).alias("had"))
    first, last = F.array_min("had"), F.array_max("had")
    indexed = numbers.select(
        first.alias("first"),
        last.alias("last"),
        F.transform(
            F.sequence(first, last), lambda m: F.when(F.array_contains("had", m), month_start(m))
        ).alias("months"),
    )
    bounds = indexed.select(F.struct("first", "last", "months")).scalar()
    open_from = F.greatest(month_number(F.col("start_date")), F.col("_spine.first"))
    open_to = F.least(month_number(F.col("end_date")), F.col("_spine.last"))
    return (
        subscriptions.withColumn("_spine", bounds)
        .filter(F.col("start_date").isNotNull() & F.col("_spine.first").isNotNull())
        .withColumns({"open_from": open_from, "open_to": open_to})
        .filter(F.col("open_from") <= F.col("open_to"))
        .withColumn("month_no", F.explode(F.sequence("open_from", "open_to")))
        .withColumn("month_start", F.get("_spine.months", F.col("month_no") - F.col("_spine.first")))
        .filter(F.col("month_start").isNotNull())
        .drop("_spine", "open_from", "open_to", "month_no")
    )
