"""Observed subscription value by signup cohort; nothing is extrapolated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.measures import from_hundredths, hundredths, mean_half_up
from spanledger.functions.months import month_label, month_start
from spanledger.operators.retention import (
    DEFAULT_MONTHS,
    cohort_activity,
    cohort_numbers,
    numbered_cohort_sizes,
    with_cohort_size,
)
from spanledger.plans.history import History, last_start_of
from spanledger.plans.spine import last_spine_month, last_start_month
from spanledger.plans.steps import RUNNING, monthly_steps, open_spans, running_over_spine

_MRR = "mrr_amount"


def _per_account() -> Column:
    return mean_half_up(F.col("mrr"), F.col("cohort_size"), 2, scale=2)


def value_by_cohort(
    accounts: DataFrame,
    subscriptions: DataFrame | History,
    spine: DataFrame,
    max_m: int | None = DEFAULT_MONTHS,
    cap_to_observed: bool = False,
) -> DataFrame:
    """Open records, their amount, and the amount so far, per cohort and months since signup.

    Months after the 18th since signup are left out by default; ``max_m=None``
    reports all.  Months outside the spine are left out, of the running amount too.
    """
    last = last_start_of(subscriptions) if cap_to_observed else last_spine_month(spine)
    activity = cohort_activity(accounts, subscriptions, last, max_m, with_mrr=True, spine=spine)
    so_far = Window.partitionBy("cohort_no").orderBy("m").rowsBetween(*RUNNING)
    return (
        with_cohort_size(activity, accounts)
        .select(
            "cohort_month",
            "months_since_signup",
            "cohort_size",
            F.col("open_records").alias("open_subscription_records"),
            from_hundredths(F.col("mrr")).alias("observed_subscription_mrr"),
            _per_account().alias("observed_mrr_per_cohort_account"),
            from_hundredths(F.sum("mrr").over(so_far)).alias("cumulative_observed_mrr"),
        )
        .orderBy("cohort_month", "months_since_signup")
    )


def value_first_6_months(
    accounts: DataFrame, subscriptions: DataFrame, months: int = 6
) -> DataFrame:
    """Amount per cohort over its first months, for cohorts old enough to have seen them.

    A record adds its amount once per month it shares with the first ``months``
    of the cohort.  Records are summed per account and span before the join.
    """
    per_span = (
        open_spans(subscriptions)
        .groupBy("account_id", "open_from", "open_to")
        .agg(F.sum(hundredths(subscriptions, _MRR)).alias("mrr"))
    )
    last = last_start_month(subscriptions)
    cohort = F.col("cohort_no")
    first = F.greatest(F.col("open_from") - cohort, F.lit(0))
    final = F.least(F.col("open_to") - cohort, F.lit(months - 1))
    shared = final - first + 1
    return (
        cohort_numbers(accounts)
        .filter(cohort <= last - (months - 1))
        .join(per_span, "account_id")
        .filter(F.col("open_to") >= cohort)
        .groupBy("cohort_no")
        .agg(F.sum(F.when(shared > 0, F.col("mrr") * shared)).alias("mrr"))
        .join(numbered_cohort_sizes(accounts), "cohort_no")
        .select(
            month_label(month_start(cohort)).alias("cohort_month"),
            "cohort_size",
            from_hundredths(F.col("mrr")).alias(f"observed_mrr_first_{months}_months"),
            _per_account().alias(f"observed_mrr_per_account_first_{months}_months"),
        )
        .orderBy("cohort_month")
    )


def value_reconcile(
    accounts: DataFrame, subscriptions: DataFrame, spine: DataFrame, months: int | None = None
) -> DataFrame:
    """Monthly amount through the cohorts against the direct sum, in every month or the first ``months``."""
    spans = open_spans(subscriptions)
    amounts = {"records": F.lit(1), "mrr": hundredths(subscriptions, _MRR)}

    direct = running_over_spine(monthly_steps(spans, amounts), spine, list(amounts))
    of_accounts = (
        monthly_steps(spans, amounts, ["account_id"])
        .join(cohort_numbers(accounts).select("account_id"), "account_id")
        .groupBy("month_no")
        .agg(*[F.sum(a).alias(a) for a in amounts])
    )
    cohorts = running_over_spine(of_accounts, spine, list(amounts))
    result = (
        cohorts.filter("records > 0")
        .select("month_start", from_hundredths(F.col("mrr")).alias("mrr_via_cohort_path"))
        .join(
            direct.filter("records > 0").select(
                "month_start", from_hundredths(F.col("mrr")).alias("mrr_via_direct_path")
            ),
            "month_start",
        )
        .select(
            month_label(F.col("month_start")).alias("month"),
            "mrr_via_cohort_path",
            "mrr_via_direct_path",
            (F.col("mrr_via_cohort_path") == F.col("mrr_via_direct_path")).alias("reconciles"),
        )
        .orderBy("month")
    )
    return result if months is None else result.limit(months)
