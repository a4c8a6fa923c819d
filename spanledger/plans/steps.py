"""Monthly totals over open records without one row per record and month.

A record open from month f to month t adds its amount at f and takes it back at
t + 1.  Summing these steps per month and then running over the months gives
the total of the open records in each month.  Steps add up on the map side, so
what is shuffled is bounded by months (or accounts x months), not by records,
and a hot account shrinks to one row per month before it is moved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.months import NEVER_ENDS, month_number, month_start

RUNNING = (Window.unboundedPreceding, Window.currentRow)


def open_spans(subscriptions: DataFrame) -> DataFrame:
    """Add ``open_from`` and ``open_to`` month numbers; records that end before they start go."""
    open_to = F.coalesce(month_number(F.col("end_date")), F.lit(NEVER_ENDS))
    return subscriptions.withColumns(
        {"open_from": month_number(F.col("start_date")), "open_to": open_to}
    ).filter(F.col("open_from") <= F.col("open_to"))


def monthly_steps(
    spans: DataFrame, amounts: Mapping[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Net change of each amount per key and month."""
    opens, closes = F.col("open_from"), F.col("open_to") + 1
    months = F.when(F.col("open_to") < NEVER_ENDS, F.array(opens, closes)).otherwise(F.array(opens))
    return (
        spans.select(
            *keys,
            *[amount.alias(name) for name, amount in amounts.items()],
            F.posexplode(months).alias("closing", "month_no"),
        )
        .groupBy(*keys, "month_no")
        .agg(*[F.sum(F.when(F.col("closing") == 0, F.col(a)).otherwise(-F.col(a))).alias(a) for a in amounts])
    )


def monthly_steps_and_starts(subscriptions: DataFrame, amounts: Mapping[str, Column]) -> DataFrame:
    """``monthly_steps`` of all records, and ``starts``, the records that start in a month.

    A record that ends before it starts changes no amount, but its start counts,
    so the range of starts comes out of the same pass.
    """
    spans = subscriptions.withColumns(
        {
            "open_from": month_number(F.col("start_date")),
            "open_to": F.coalesce(month_number(F.col("end_date")), F.lit(NEVER_ENDS)),
        }
    ).filter(F.col("open_from").isNotNull())
    real = F.col("open_from") <= F.col("open_to")
    counted = {name: F.when(real, amount).otherwise(F.lit(0)) for name, amount in amounts.items()}
    closing = F.when(real, F.col("open_to")).otherwise(F.lit(NEVER_ENDS))
    opens, closes = F.col("open_from"), closing + 1
    months = F.when(closing < NEVER_ENDS, F.array(opens, closes)).otherwise(F.array(opens))
    return (
        spans.select(
            *[amount.alias(name) for name, amount in counted.items()],
            F.posexplode(months).alias("closing", "month_no"),
        )
        .groupBy("month_no")
        .agg(
            F.count(F.when(F.col("closing") == 0, F.lit(1))).alias("starts"),
            *[F.sum(F.when(F.col("closing") == 0, F.col(a)).otherwise(-F.col(a))).alias(a) for a in counted],
        )
    )


def _last_start() -> Column:
    return F.max(F.when(F.col("starts") > 0, F.col("month_no"))).over(Window.partitionBy())


def running_between_starts(steps: DataFrame, amounts: Sequence[str]) -> DataFrame:
    """Totals in every month from the first start to the last, from steps with ``starts``.

    The windows have no partition key; they see one row per month with a step.
    """
    by_month = Window.orderBy("month_no")
    following = F.lead("month_no").over(by_month) - 1
    return (
        steps.select(
            "month_no",
            F.least(F.coalesce(following, _last_start()), _last_start()).alias("until"),
            *[F.sum(a).over(by_month.rowsBetween(*RUNNING)).alias(a) for a in amounts],
        )
        .filter(F.col("month_no") <= F.col("until"))
        .select(F.explode(F.sequence("month_no", "until")).alias("month_no"), *amounts)
        .withColumn("month_start", month_start(F.col("month_no")))
        .drop("month_no")
    )


def running_over_spine(
    steps: DataFrame, spine: DataFrame, amounts: Sequence[str], to_last_start: bool = False
) -> DataFrame:
    """Totals at every spine month, from steps that hold at most one row per month.

    ``to_last_start`` stops at the month of the last of the steps' ``starts``.
    The window has no partition key; it sees one row per calendar month.
    """
    months = spine.select(
        month_number(F.col("month_start")).alias("month_no"), F.lit(True).alias("in_spine")
    )
    merged = (
        steps.withColumn("in_spine", F.lit(False))
        .unionByName(months, allowMissingColumns=True)
        .groupBy("month_no")
        .agg(
            F.max("in_spine").alias("in_spine"),
            *[F.sum(a).alias(a) for a in [*amounts, *(["starts"] if to_last_start else [])]],
        )
    )
    if to_last_start:
        merged = merged.withColumn("last", _last_start()).filter(F.col("month_no") <= F.col("last"))
        merged = merged.drop("starts", "last")
    run = Window.orderBy("month_no").rowsBetween(*RUNNING)
    return (
        merged.withColumns({a: F.coalesce(F.sum(a).over(run), F.lit(0)) for a in amounts})
        .filter("in_spine")
        .withColumn("month_start", month_start(F.col("month_no")))
        .drop("in_spine", "month_no")
    )


def account_segments(subscriptions: DataFrame, amounts: Mapping[str, Column]) -> DataFrame:
    """Stretches of months, disjoint per account, over which its open records do not change.

    One row per account and stretch with at least one open record:
    ``seg_from``, ``seg_to``, ``open_records`` and the summed ``amounts``.
    """
    columns = {"open_records": F.lit(1), **amounts}
    steps = monthly_steps(open_spans(subscriptions), columns, ["account_id"])
    by_month = Window.partitionBy("account_id").orderBy("month_no")
    following = F.lead("month_no").over(by_month) - 1
    return (
        steps.select(
            "account_id",
            F.col("month_no").alias("seg_from"),
            F.coalesce(following, F.lit(NEVER_ENDS)).alias("seg_to"),
            *[F.sum(c).over(by_month.rowsBetween(*RUNNING)).alias(c) for c in columns],
        )
        .filter("open_records > 0")
    )


def account_spans(subscriptions: DataFrame) -> DataFrame:
    """Open spans per account, one row per account and first month.

    Spans that begin in the same month are nested, so the longest stands for all.
    """
    return (
        open_spans(subscriptions)
        .groupBy("account_id", "open_from")
        .agg(F.max("open_to").alias("open_to"))
    )
