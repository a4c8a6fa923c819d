"""Trial conversion, per trial record and per account.

A trial record counts as converted when its account holds a paid record that
starts on the same day or later.  The latest paid start per account decides it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.measures import count_where, pct
from spanledger.functions.months import month_label
from spanledger.plans.relations import account_cohorts


def _trials_with_outcome(subscriptions: DataFrame) -> DataFrame:
    """Trial records counted per account, plan and start day, with their outcome.

    One pass: an account's paid records become one row with their latest start,
    which a window over the account's few rows brings to its trials.
    """
    trial = F.col("is_trial")
    combined = subscriptions.groupBy(
        "account_id",
        trial.alias("is_trial"),
        F.when(trial, F.col("plan_tier")).alias("plan_tier"),
        F.when(trial, F.col("start_date")).alias("start_date"),
    ).agg(F.count("*").alias("n"), F.max(F.when(~trial, F.col("start_date"))).alias("paid_start"))
    last_paid = F.max("paid_start").over(Window.partitionBy("account_id"))
    return (
        combined.withColumn("last_paid_start", last_paid)
        .filter("is_trial")
        .withColumn(
            "converted", F.when(F.col("last_paid_start") >= F.col("start_date"), F.col("n")).otherwise(0)
        )
    )


def _conversion(df: DataFrame, by: Sequence[str], total: str, converted: str, rate: str) -> DataFrame:
    return (
        df.groupBy(*by)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias(total),
            F.coalesce(F.sum("converted"), F.lit(0)).alias(converted),
        )
        .withColumn(rate, pct(F.col(converted), F.col(total)))
    )


def conv_subscription_overall(subscriptions: DataFrame) -> DataFrame:
    return _conversion(
        _trials_with_outcome(subscriptions),
        [],
        "total_trial_subscription_records",
        "trial_records_with_later_paid_record",
        "subscription_level_conversion_rate_pct",
    )


def conv_subscription_by_plan(subscriptions: DataFrame) -> DataFrame:
    """Trial conversion by the plan of the trial, best first."""
    return _conversion(
        _trials_with_outcome(subscriptions),
        ["plan_tier"],
        "trial_records",
        "trial_records_with_later_paid_record",
        "conversion_rate_pct",
    ).orderBy(F.col("conversion_rate_pct").desc(), "plan_tier")


def _trial_and_paid(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("account_id").agg(
        F.bool_or("is_trial").alias("had_trial"), F.bool_or(~F.col("is_trial")).alias("had_paid")
    )


def _account_conversion(df: DataFrame, by: Sequence[str], rate: str) -> DataFrame:
    trial = F.col("had_trial")
    return (
        df.groupBy(*by)
        .agg(
            count_where(trial).alias("accounts_with_any_trial"),
            count_where(trial & F.col("had_paid")).alias("accounts_with_trial_and_paid"),
        )
        .withColumn(
            rate, pct(F.col("accounts_with_trial_and_paid"), F.col("accounts_with_any_trial"))
        )
    )


def conv_account_overall(subscriptions: DataFrame) -> DataFrame:
    """Of the accounts that ever had a trial, those that ever had a paid record."""
    return _account_conversion(
        _trial_and_paid(subscriptions), [], "account_level_conversion_rate_pct"
    )


def conv_account_by_cohort(accounts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Account-level conversion per signup month; NULL for a month without trials."""
    joined = _trial_and_paid(subscriptions).join(account_cohorts(accounts), "account_id")
    return (
        _account_conversion(joined, ["cohort_month"], "conversion_rate_pct")
        .withColumn("cohort_month", month_label(F.col("cohort_month")))
        .orderBy("cohort_month")
    )


def conv_reconcile(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.agg(
        count_where(F.col("is_trial")).alias("trial_records_check"),
        count_where(~F.col("is_trial")).alias("paid_records_check"),
    )
