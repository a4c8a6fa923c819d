"""Aggregate recurring revenue over open subscription records, by month.

A record counts in every month it is open, so an account with several open
records is counted several times: these are totals of records, not of customers.
``subscription_id`` is the declared key of the table (``dq02_key_uniqueness``
checks it), so counting records counts distinct ids.

Months without an open record are absent, so the monthly operators need a spine
only to restrict the months.  Without one they run over the months from the
first to the latest start, which is the same result from one table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.measures import from_hundredths, hundredths, sum_where
from spanledger.functions.months import month_label, month_start
from spanledger.plans.spine import last_start_month
from spanledger.plans.steps import monthly_steps_and_starts, running_between_starts, running_over_spine
from spanledger.schema import PLAN_TIERS


def _monthly_totals(
    subscriptions: DataFrame, spine: DataFrame | None, amounts: Mapping[str, Column]
) -> DataFrame:
    """Totals per month with an open record, to the month of the latest start, in one pass."""
    columns = {"records": F.lit(1), **amounts}
    return _totals_of(monthly_steps_and_starts(subscriptions, columns), spine, list(columns))


def _totals_of(steps: DataFrame, spine: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """The same totals from steps with ``starts``."""
    if spine is None:
        totals = running_between_starts(steps, columns)
    else:
        totals = running_over_spine(steps, spine, columns, to_last_start=True)
    return totals.filter("records > 0")


def _only(condition: Column, amount: Column) -> Column:
    return F.when(condition, amount).otherwise(F.lit(0))


def _by_month(df: DataFrame, *columns: Column | str) -> DataFrame:
    label = month_label(F.col("month_start")).alias("month_label")
    return df.select(label, "month_start", *columns).orderBy("month_start")


def mrr_monthly(subscriptions: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """Open records and their summed monthly amount."""
    amounts = {"mrr": hundredths(subscriptions, "mrr_amount")}
    return _mrr_monthly(_monthly_totals(subscriptions, spine, amounts))


def mrr_monthly_of(steps: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """``mrr_monthly`` from ``plan_steps``, also from those of several batches added up."""
    return _mrr_monthly(_totals_of(steps.select("month_no", "starts", "records", "mrr"), spine, ["records", "mrr"]))


def _mrr_monthly(totals: DataFrame) -> DataFrame:
    return _by_month(
        totals,
        F.col("records").alias("active_subscription_records"),
        from_hundredths(F.col("mrr")).alias("aggregate_subscription_mrr"),
    )


def _plan_amounts(subscriptions: DataFrame, tiers: Sequence[str]) -> dict[str, Column]:
    mrr = hundredths(subscriptions, "mrr_amount")
    amounts = {"mrr": mrr}
    for tier in tiers:
        on_tier = F.col("plan_tier") == tier
        amounts[f"{tier}_records"] = _only(on_tier, F.lit(1))
        amounts[f"{tier}_mrr"] = _only(on_tier, mrr)
    return amounts


def plan_steps(subscriptions: DataFrame, tiers: Sequence[str] = PLAN_TIERS) -> DataFrame:
    """What the records change per month, in all and per plan, and how many start: these add up
    over disjoint sets of records."""
    return monthly_steps_and_starts(
        subscriptions, {"records": F.lit(1), **_plan_amounts(subscriptions, tiers)}
    )


def mrr_by_plan(
    subscriptions: DataFrame,
    spine: DataFrame | None = None,
    tiers: Sequence[str] = PLAN_TIERS,
) -> DataFrame:
    """Summed monthly amount per plan; NULL where a plan has no open record."""
    return _mrr_by_plan(_monthly_totals(subscriptions, spine, _plan_amounts(subscriptions, tiers)), tiers)


def mrr_by_plan_of(
    steps: DataFrame, spine: DataFrame | None = None, tiers: Sequence[str] = PLAN_TIERS
) -> DataFrame:
    """``mrr_by_plan`` from ``plan_steps``, also from those of several batches added up."""
    columns = [c for c in steps.columns if c not in ("month_no", "starts")]
    return _mrr_by_plan(_totals_of(steps, spine, columns), tiers)


def _mrr_by_plan(totals: DataFrame, tiers: Sequence[str]) -> DataFrame:
    return _by_month(
        totals,
        *[
            F.when(F.col(f"{tier}_records") > 0, from_hundredths(F.col(f"{tier}_mrr"))).alias(
                f"{tier.lower()}_mrr"
            )
            for tier in tiers
        ],
        from_hundredths(F.col("mrr")).alias("total_mrr"),
    )


def mrr_trial_paid(subscriptions: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """Open trial and paid records, and the paid amount."""
    trial, paid = F.col("is_trial"), ~F.col("is_trial")
    totals = _monthly_totals(
        subscriptions,
        spine,
        {
            "trials": _only(trial, F.lit(1)),
            "paid": _only(paid, F.lit(1)),
            "paid_amount": _only(paid, hundredths(subscriptions, "mrr_amount")),
        },
    )
    return _by_month(
        totals,
        F.col("trials").alias("open_trial_records"),
        F.col("paid").alias("open_paid_records"),
        F.when(F.col("paid") > 0, from_hundredths(F.col("paid_amount"))).alias("paid_mrr"),
    )


def latest_month_mrr(subscriptions: DataFrame) -> Column:
    """Amount open in the month of the latest start, told from the dates of each record alone."""
    month = month_start(last_start_month(subscriptions))
    ends = F.col("end_date")
    is_open = (F.col("start_date") <= F.last_day(month)) & (ends.isNull() | (ends >= month))
    return from_hundredths(sum_where(is_open, hundredths(subscriptions, "mrr_amount")))


def mrr_reconcile(subscriptions: DataFrame) -> DataFrame:
    """Latest month without the spine, and the sum over all records as a bound."""
    everything = F.sum(hundredths(subscriptions, "mrr_amount"))
    return subscriptions.agg(
        latest_month_mrr(subscriptions).alias("latest_month_mrr_direct_calc"),
        from_hundredths(everything).alias("all_time_sum_mrr_upper_bound"),
    )
