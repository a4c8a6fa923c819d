"""Churn status, usage per account and signup cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.months import first_of_month


def churn_status(df: DataFrame, churn: DataFrame, on: str = "account_id") -> DataFrame:
    """Add ``is_churned_account``: the account has at least one churn event."""
    churned = churn.select(F.col("account_id").alias(on)).distinct()
    return df.join(churned.withColumn("_churned", F.lit(True)), on, "left").select(
        *df.columns, F.col("_churned").isNotNull().alias("is_churned_account")
    )


def events_per_account(churn: DataFrame) -> DataFrame:
    """Churn events per churned account."""
    return churn.groupBy("account_id").agg(F.count("*").alias("events_per_account"))


def usage_with_account(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Usage rows with the account that holds their subscription record.

    The join ignores dates on purpose: usage often lies outside the record's window.
    """
    bridge = subscriptions.select("subscription_id", "account_id")
    return usage.join(bridge, "subscription_id")


def usage_per_account(
    usage: DataFrame,
    subscriptions: DataFrame,
    totals: Mapping[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Usage totals per account, and per ``by`` column.

    Without ``by``, usage is summed per record first: the join needs that
    distribution anyway, so usage moves once, already combined.  With ``by`` that
    would be a shuffle of its own which combines next to nothing, so usage is
    joined as it is (a hot record is split by the adaptive skew join) and combined
    before the next exchange.
    """
    named = [total.alias(name) for name, total in totals.items()]
    if by:
        return usage_with_account(usage, subscriptions).groupBy(*by, "account_id").agg(*named)
    return (
        usage_with_account(usage.groupBy("subscription_id").agg(*named), subscriptions)
        .groupBy("account_id")
        .agg(*[F.sum(name).alias(name) for name in totals])
    )


def account_cohorts(accounts: DataFrame) -> DataFrame:
    """Signup month per account."""
    return accounts.select("account_id", first_of_month(F.col("signup_date")).alias("cohort_month"))


def cohort_sizes(accounts: DataFrame) -> DataFrame:
    """Accounts per signup month."""
    return (
        account_cohorts(accounts)
        .groupBy("cohort_month")
        .agg(F.count("*").alias("cohort_size"))
    )
