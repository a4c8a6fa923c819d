"""Account acquisition by month, channel, plan, industry and country."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.measures import count_where, rank_desc, share_of_total
from spanledger.functions.months import first_of_month
from spanledger.schema import PLAN_TIERS


def acq_monthly(accounts: DataFrame, spine: DataFrame) -> DataFrame:
    """New accounts per month to the last signup month; months without any are 0."""
    monthly = accounts.groupBy(first_of_month(F.col("signup_date")).alias("month_start")).agg(
        F.count("account_id").alias("n")
    )
    last = accounts.agg(first_of_month(F.max("signup_date"))).scalar()
    return (
        spine.filter(F.col("month_start") <= last)
        .join(monthly, "month_start", "left")
        .select("month_label", "month_start", F.coalesce("n", F.lit(0)).alias("new_accounts"))
        .orderBy("month_start")
    )


#: The categories of an account by which it is counted.
GROUPINGS = ("referral_source", "plan_tier", "industry", "country")


def acq_groupings(accounts: DataFrame, by: Sequence[str] = GROUPINGS) -> DataFrame:
    """Accounts by each of several columns, in one pass: ``field``, ``value`` and the counts.

    Rows are combined per value on the map side, so what moves is bounded by the
    number of values.  Store it to derive the four ``acq_by_`` results of one scan.
    """
    source = F.col("referral_source")
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in by]))
    return (
        accounts.select(source, values.alias("of"))
        .groupBy(F.col("of.field").alias("field"), F.col("of.value").alias("value"))
        .agg(
            F.count("*").alias("account_count"),
            count_where(source == "organic").alias("organic_accounts"),
            count_where(source == "partner").alias("partner_accounts"),
        )
    )


def _counted(accounts: DataFrame, by: str, groupings: DataFrame | None) -> DataFrame:
    """Accounts per value of one column, from ``groupings`` where they are given."""
    groupings = acq_groupings(accounts, [by]) if groupings is None else groupings
    return groupings.filter(F.col("field") == by).withColumnRenamed("value", by).drop("field")


def _ranked(counts: DataFrame, by: str, rank: str) -> DataFrame:
    return counts.select(
        by,
        "account_count",
        share_of_total(F.col("account_count")).alias("pct_of_total_accounts"),
        rank_desc(F.col("account_count")).alias(rank),
    ).orderBy(F.col("account_count").desc(), by)


def acq_by_referral(accounts: DataFrame, groupings: DataFrame | None = None) -> DataFrame:
    counts = _counted(accounts, "referral_source", groupings)
    return _ranked(counts, "referral_source", "acquisition_rank").withColumnRenamed(
        "account_count", "accounts_acquired"
    )


def acq_by_plan(accounts: DataFrame, groupings: DataFrame | None = None) -> DataFrame:
    """Accounts by their current plan; the plan at signup is not recorded."""
    return (
        _counted(accounts, "plan_tier", groupings)
        .select("plan_tier", "account_count")
        .withColumn("pct_of_total_accounts", share_of_total(F.col("account_count")))
        .orderBy(F.col("account_count").desc(), "plan_tier")
    )


def acq_by_industry(accounts: DataFrame, groupings: DataFrame | None = None) -> DataFrame:
    """Accounts by industry, with those that came organically or through a partner."""
    return (
        _counted(accounts, "industry", groupings)
        .select(
            "industry",
            "account_count",
            share_of_total(F.col("account_count")).alias("pct_of_total_accounts"),
            "organic_accounts",
            "partner_accounts",
            rank_desc(F.col("account_count")).alias("industry_rank"),
        )
        .orderBy(F.col("account_count").desc(), "industry")
    )


def acq_by_country(accounts: DataFrame, groupings: DataFrame | None = None) -> DataFrame:
    return _ranked(_counted(accounts, "country", groupings), "country", "country_rank")


def acq_referral_by_plan(accounts: DataFrame, tiers: Sequence[str] = PLAN_TIERS) -> DataFrame:
    """Accounts per channel, one column per plan."""
    return (
        accounts.groupBy("referral_source")
        .agg(
            *[
                count_where(F.col("plan_tier") == tier).alias(f"{tier.lower()}_accounts")
                for tier in tiers
            ],
            F.count("*").alias("total_accounts"),
        )
        .orderBy(F.col("total_accounts").desc(), "referral_source")
    )


def acq_reconcile(accounts: DataFrame, spine: DataFrame) -> DataFrame:
    """Total accounts by month, by channel and directly, side by side."""
    by_month = acq_monthly(accounts, spine).agg(F.sum("new_accounts"))
    by_channel = acq_by_referral(accounts).agg(F.sum("accounts_acquired"))
    return accounts.agg(F.count("*").alias("total_accounts_actual")).select(
        by_month.scalar().alias("total_via_monthly"),
        by_channel.scalar().alias("total_via_referral_source"),
        "total_accounts_actual",
    )


def acq_rolling_mean(monthly: DataFrame, months: int = 3) -> DataFrame:
    """Centred moving mean of new accounts; NULL where the window is cut off.

    Takes the monthly mart, so the unpartitioned window sees one row per month.
    """
    reach = months // 2
    centred = Window.orderBy("month_start").rowsBetween(-reach, months - reach - 1)
    mean = F.avg("new_accounts").over(centred)
    return monthly.select(
        "month_label",
        "month_start",
        "new_accounts",
        F.when(F.count("*").over(centred) == months, mean).alias("rolling_avg"),
    ).orderBy("month_start")
