"""Account retention by signup cohort.

An account is active in a month when at least one of its subscription records
is open in it.  A cohort is the month of signup.

Operators that take ``DataFrame | History`` read the records, or the stretches
stored by ``plans.history`` that several of them share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.measures import count_where, mean_half_up, pct
from spanledger.functions.months import month_label, month_number, month_start
from spanledger.plans.history import History, last_start_of, segments_of
from spanledger.plans.relations import cohort_sizes
from spanledger.plans.spine import first_spine_month, last_spine_month
from spanledger.plans.steps import account_spans

# Months since signup reported unless told otherwise; None reports the whole history.
DEFAULT_MONTHS = 18


def cohort_numbers(accounts: DataFrame) -> DataFrame:
    """Signup month number per account."""
    return accounts.select("account_id", month_number(F.col("signup_date")).alias("cohort_no"))


def numbered_cohort_sizes(accounts: DataFrame) -> DataFrame:
    return cohort_sizes(accounts).select(
        month_number(F.col("cohort_month")).alias("cohort_no"), "cohort_size"
    )


def cohort_activity(
    accounts: DataFrame,
    records: DataFrame | History,
    last_month: Column,
    max_m: int | None,
    with_mrr: bool = False,
    spine: DataFrame | None = None,
) -> DataFrame:
    """Active accounts, open records and their amount (``mrr``) per cohort and months since signup.

    An account's segments are disjoint, so it enters each month once: at most
    ``max_m + 1`` rows per account are made, or one per month up to ``last_month``,
    however many records it holds.  With a ``spine`` only its months count; it is
    joined with the summed cells.
    """
    columns = ["open_records", "mrr"] if with_mrr else ["open_records"]
    cohort = F.col("cohort_no")
    horizon = last_month - cohort if max_m is None else F.least(F.lit(max_m), last_month - cohort)
    earliest = F.lit(0) if spine is None else F.greatest(first_spine_month(spine) - cohort, F.lit(0))
    cells = (
        segments_of(records, with_mrr)
        .join(cohort_numbers(accounts), "account_id")
        .withColumns(
            {
                "m_from": F.greatest(F.col("seg_from") - cohort, earliest),
                "m_to": F.least(F.col("seg_to") - cohort, horizon),
            }
        )
        .filter(F.col("m_from") <= F.col("m_to"))
        .select("cohort_no", *columns, F.explode(F.sequence("m_from", "m_to")).alias("m"))
        .groupBy("cohort_no", "m")
        .agg(F.count("*").alias("active_accounts"), *[F.sum(c).alias(c) for c in columns])
    )
    if spine is None:
        return cells
    months = spine.select(month_number(F.col("month_start")).alias("month_no"))
    return (
        cells.withColumn("month_no", cohort + F.col("m")).join(months, "month_no", "left_semi").drop("month_no")
    )


def with_cohort_size(activity: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add cohort size and the cohort and month columns under which results are reported."""
    return activity.join(numbered_cohort_sizes(accounts), "cohort_no").withColumns(
        {
            "cohort_month": month_label(month_start(F.col("cohort_no"))),
            "months_since_signup": F.col("m").cast("bigint"),
        }
    )


def ret_matrix(
    accounts: DataFrame,
    subscriptions: DataFrame | History,
    spine: DataFrame,
    max_m: int | None = DEFAULT_MONTHS,
    cap_to_observed: bool = False,
) -> DataFrame:
    """Retention per cohort and months since signup, populated cells only.

    Months after the 18th since signup are left out by default; ``max_m=None``
    reports all.  Months outside the spine are left out.  By default months run to the end of the spine, so its buffer months count
    open records beyond the data; ``cap_to_observed`` stops at the latest start.
    """
    last = last_start_of(subscriptions) if cap_to_observed else last_spine_month(spine)
    activity = cohort_activity(accounts, subscriptions, last, max_m, spine=spine)
    active = F.col("active_accounts")
    return (
        with_cohort_size(activity, accounts)
        .select(
            "cohort_month",
            "months_since_signup",
            "cohort_size",
            active,
            pct(active, F.col("cohort_size")).alias("retention_rate_pct"),
            mean_half_up(F.col("open_records"), active, 1).alias(
                "avg_open_sub_records_per_active_account"
            ),
        )
        .orderBy("cohort_month", "months_since_signup")
    )


def ret_pooled_curve(
    accounts: DataFrame, subscriptions: DataFrame | History, max_m: int | None = DEFAULT_MONTHS
) -> DataFrame:
    """Retention per months since signup over the cohorts old enough to have reached them.

    Months after the 18th since signup are left out by default; ``max_m=None``
    reports all.

    Cohorts whose month M lies after the latest subscription start are left out
    of numerator and denominator alike, so young cohorts do not look lost.  The
    spine reaches beyond that month, so it is not needed here.
    """
    last = last_start_of(subscriptions)
    oldest = last - F.col("cohort_no")
    if max_m is not None:
        oldest = F.least(F.lit(max_m), oldest)
    eligible = (
        numbered_cohort_sizes(accounts)
        .withColumn("oldest", oldest)
        .filter("oldest >= 0")
        .select("cohort_size", F.explode(F.sequence(F.lit(0), F.col("oldest"))).alias("m"))
        .groupBy("m")
        .agg(F.sum("cohort_size").alias("eligible_accounts"))
    )
    active = (
        cohort_activity(accounts, subscriptions, last, max_m)
        .groupBy("m")
        .agg(F.sum("active_accounts").alias("n"))
    )
    return (
        eligible.join(active, "m", "left")
        .select(
            F.col("m").cast("bigint").alias("months_since_signup"),
            "eligible_accounts",
            F.coalesce("n", F.lit(0)).alias("active_accounts"),
        )
        .withColumn(
            "retention_rate_pct_eligible_cohorts_only",
            pct(F.col("active_accounts"), F.col("eligible_accounts")),
        )
        .orderBy("months_since_signup")
    )


def _active_in(cohorts: DataFrame, subscriptions: DataFrame | History, month: str) -> DataFrame:
    """Accounts of ``cohorts``, and whether one of their records is open in month ``month``.

    The join sees at most one span per account and first month.
    """
    is_open = (F.col("open_from") <= F.col(month)) & (F.col("open_to") >= F.col(month))
    if isinstance(subscriptions, History):
        spans = subscriptions.segments.selectExpr("account_id", "seg_from AS open_from", "seg_to AS open_to")
    else:
        spans = account_spans(subscriptions)
    return (
        cohorts.join(spans, "account_id", "left")
        .groupBy("account_id")
        .agg(F.bool_or(is_open).alias("active"))
    )


def ret_month_m_check(accounts: DataFrame, subscriptions: DataFrame | History, m: int = 6) -> DataFrame:
    """Retention at one month since signup, by a direct look at that month."""
    eligible = (
        cohort_numbers(accounts)
        .withColumn("target", F.col("cohort_no") + m)
        .filter(F.col("target") <= last_start_of(subscriptions))
    )
    in_all, still = f"eligible_accounts_month{m}", f"active_accounts_month{m}"
    return (
        _active_in(eligible, subscriptions, "target")
        .agg(F.count("*").alias(in_all), count_where(F.col("active")).alias(still))
        .withColumn("retention_rate_pct_cross_check", pct(F.col(still), F.col(in_all)))
    )


def ret_ever_active(accounts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Accounts without and with any subscription record."""
    holders = subscriptions.select("account_id").distinct().withColumn("held", F.lit(True))
    return (
        accounts.select("account_id")
        .join(holders, "account_id", "left")
        .agg(
            count_where(F.col("held").isNull()).alias("accounts_never_active"),
            count_where(F.col("held")).alias("accounts_active_at_least_once"),
        )
    )


def ret_active_in_signup_month(accounts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """All accounts, and those with a record open in their own signup month."""
    return _active_in(cohort_numbers(accounts), subscriptions, "cohort_no").agg(
        F.count("*").alias("total_accounts"),
        count_where(F.col("active")).alias("accounts_active_in_own_signup_month"),
    )
