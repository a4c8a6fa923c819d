"""Churn events and churned accounts, always as separate measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.functions.measures import (
    count_where,
    from_hundredths,
    hundredths,
    mean_half_up,
    pct,
    rank_desc,
    share_of_total,
)
from spanledger.functions.months import first_of_month
from spanledger.plans.relations import events_per_account


def churn_monthly(churn: DataFrame, spine: DataFrame) -> DataFrame:
    """Events and distinct accounts per month to the last event; months without any are 0."""
    monthly = churn.groupBy(first_of_month(F.col("churn_date")).alias("month_start")).agg(
        F.count("churn_event_id").alias("events"), F.countDistinct("account_id").alias("accounts")
    )
    last = churn.agg(first_of_month(F.max("churn_date"))).scalar()
    return (
        spine.filter(F.col("month_start") <= last)
        .join(monthly, "month_start", "left")
        .select(
            "month_label",
            "month_start",
            F.coalesce("events", F.lit(0)).alias("churn_events"),
            F.coalesce("accounts", F.lit(0)).alias("unique_churned_accounts"),
        )
        .orderBy("month_start")
    )


def churn_by_reason(churn: DataFrame) -> DataFrame:
    return (
        churn.groupBy("reason_code")
        .agg(
            F.count("*").alias("churn_events"),
            F.countDistinct("account_id").alias("unique_accounts"),
        )
        .withColumns(
            {
                "pct_of_all_churn_events": share_of_total(F.col("churn_events")),
                "reason_rank": rank_desc(F.col("churn_events")),
            }
        )
        .orderBy(F.col("churn_events").desc(), "reason_code")
    )


def churn_by_plan(churn: DataFrame, accounts: DataFrame) -> DataFrame:
    """Churn per current plan against all accounts on it; plans without churn are left out.

    Events are counted per account first, so one pass over the accounts gives
    events, churned accounts and all accounts of a plan.
    """
    return (
        accounts.select("account_id", "plan_tier")
        .join(events_per_account(churn), "account_id", "left")
        .groupBy("plan_tier")
        .agg(
            F.sum("events_per_account").alias("churn_events"),
            F.count("events_per_account").alias("unique_churned_accounts"),
            F.count("*").alias("accounts_on_this_plan"),
        )
        .filter("churn_events > 0")
        .withColumn(
            "pct_of_plan_accounts_with_churn_event",
            pct(F.col("unique_churned_accounts"), F.col("accounts_on_this_plan")),
        )
        .orderBy(F.col("churn_events").desc(), "plan_tier")
    )


def _first_churn(churn: DataFrame, accounts: DataFrame) -> DataFrame:
    first = churn.groupBy("account_id").agg(F.min("churn_date").alias("first_churn_date"))
    return (
        accounts.select("account_id", "signup_date")
        .join(first, "account_id")
        .withColumn(
            "days_to_first_churn", F.datediff("first_churn_date", "signup_date").cast("bigint")
        )
    )


def churn_time_to_first(churn: DataFrame, accounts: DataFrame) -> DataFrame:
    """Days from signup to the first churn event per churned account, shortest first."""
    return _first_churn(churn, accounts).orderBy("days_to_first_churn", "account_id")


def churn_time_to_first_summary(churn: DataFrame, accounts: DataFrame) -> DataFrame:
    """Least, mean, median and most days to the first churn event.

    The exact median is taken over one weighted row per number of days.
    """
    per_day = (
        _first_churn(churn, accounts)
        .groupBy("days_to_first_churn")
        .agg(F.count("*").alias("accounts"))
    )
    days, accounts_at = F.col("days_to_first_churn"), F.col("accounts")
    return per_day.agg(
        F.min(days).alias("min_days"),
        mean_half_up(F.sum(days * accounts_at), F.sum(accounts_at), 1).alias("avg_days"),
        F.percentile(days, 0.5, accounts_at).alias("median_days"),
        F.max(days).alias("max_days"),
    )


def churn_repeat_histogram(churn: DataFrame) -> DataFrame:
    """Accounts per number of churn events."""
    return (
        events_per_account(churn)
        .groupBy("events_per_account")
        .agg(F.count("*").alias("accounts"))
        .orderBy("events_per_account")
    )


def churn_repeat_summary(churn: DataFrame) -> DataFrame:
    """Events, reactivations, churned accounts and accounts that churned more than once."""
    per_account = churn.groupBy("account_id").agg(
        F.count("*").alias("n"), count_where(F.col("is_reactivation")).alias("back")
    )
    return per_account.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_churn_events"),
        F.coalesce(F.sum("back"), F.lit(0)).alias("reactivation_events"),
        pct(F.sum("back"), F.sum("n")).alias("pct_reactivation_events"),
        F.count("account_id").alias("unique_churned_accounts"),
        count_where(F.col("n") > 1).alias("repeat_churn_accounts"),
    )


def churn_refund_by_reason(churn: DataFrame) -> DataFrame:
    refund = hundredths(churn, "refund_amount_usd")
    return (
        churn.groupBy("reason_code")
        .agg(
            F.count("*").alias("churn_events"),
            from_hundredths(F.sum(refund)).alias("total_refund_usd"),
            mean_half_up(F.sum(refund), F.count(refund), 2, scale=2).alias("avg_refund_usd"),
        )
        .orderBy(F.col("total_refund_usd").desc(), "reason_code")
    )


def churn_refund_total(churn: DataFrame) -> DataFrame:
    refund = hundredths(churn, "refund_amount_usd")
    return churn.agg(
        from_hundredths(F.sum(refund)).alias("total_refund_usd_all_events"),
        mean_half_up(F.sum(refund), F.count(refund), 2, scale=2).alias("avg_refund_usd_per_event"),
    )


def churn_preceding_flags(churn: DataFrame) -> DataFrame:
    """Events by whether an upgrade or a downgrade came before."""
    flags = ["preceding_upgrade_flag", "preceding_downgrade_flag"]
    return (
        churn.groupBy(*flags)
        .agg(F.count("*").alias("churn_events"))
        .withColumn("pct_of_churn_events", share_of_total(F.col("churn_events")))
        .orderBy(F.col("churn_events").desc(), *flags)
    )


def churn_reconcile(churn: DataFrame) -> DataFrame:
    """Events and accounts directly, and events summed over reasons."""
    by_reason = churn_by_reason(churn).agg(F.sum("churn_events"))
    return churn.agg(
        F.count("*").alias("total_churn_events"),
        F.countDistinct("account_id").alias("unique_churned_accounts"),
    ).withColumn("total_via_reason_code_sum", by_reason.scalar())
