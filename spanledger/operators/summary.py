"""Headline figures put together from the other operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.measures import count_where, hundredths, mean_half_up, pct, sum_where
from spanledger.functions.months import month_label, month_number, month_start
from spanledger.operators.conversion import conv_subscription_overall
from spanledger.operators.quality import as_count
from spanledger.operators.revenue import latest_month_mrr
from spanledger.plans.spine import last_start_month
from spanledger.plans.steps import account_spans


# The rows of the business summary, as text templates of metric,
# value, comparison and context.  Every %s is computed from the data.
SUMMARY_ROWS = {
    "accounts": (
        "Total accounts (%s to %s)",
        "%s",
        None,
        "Every account that signed up in these months",
    ),
    "channel": (
        "Top acquisition channel",
        "%s",
        "%s accounts",
        "Channel with the most accounts",
    ),
    "revenue": (
        "Latest month Aggregate Subscription-Record MRR (%s)",
        "$%s",
        None,
        "Sum over all records open in that month, not revenue per customer",
    ),
    "trials": (
        "Trial subscription records",
        "%s",
        "%s with a later paid record",
        "Counts records, not accounts",
    ),
    "conversion": (
        "Trial->paid conversion rate (subscription-level proxy)",
        "%s%%",
        None,
        "Proxy: a paid record of the same account starts on or after the trial",
    ),
    "retention": (
        "6-month observed account subscription retention (pooled)",
        "%s%%",
        None,
        "Accounts old enough, with a record open in the sixth month after signup",
    ),
    "feature": (
        "Most-used feature (by total usage_count)",
        "%s",
        "%s total usage_count",
        "Usage over whole account histories",
    ),
    "churn_events": (
        "Total churn events",
        "%s",
        "%s unique churned accounts",
        "From the churn events, not from the account flag",
    ),
    "churn_rate": (
        "Churned-account rate",
        "%s%%",
        None,
        "Churned accounts over all accounts, not events",
    ),
    "repeat_churn": (
        "Repeat-churn accounts",
        "%s",
        "%s reactivation events",
        "Accounts with two or more churn events",
    ),
    "satisfaction": (
        "Support ticket satisfaction score missingness",
        "%s%%",
        "Range observed: %s-%s only",
        "Scores are a biased sample of tickets",
    ),
    "resolution": (
        "Support activity: churned vs non-churned avg resolution time",
        "%sh (churned)",
        "%sh (non-churned)",
        "Association only, no causal claim",
    ),
}


def _row(df: DataFrame) -> Column:
    """A one-row relation as a scalar struct."""
    return df.select(F.struct("*")).scalar()


def _decimals(value: Column, places: int) -> Column:
    return value.cast(f"decimal(38,{places})")


def _filled(template: str | None, values: Sequence[Column]) -> Column:
    """A template with its values filled in; NULL without a template or with a NULL value."""
    if template is None:
        return F.lit(None).cast("string")
    if not values:
        return F.lit(template)
    texts = [value.cast("string") for value in values]
    known = reduce(Column.__and__, [text.isNotNull() for text in texts])
    return F.when(known, F.format_string(template, *texts))


def _largest(df: DataFrame, name: str, total: str) -> DataFrame:
    return df.orderBy(F.col(total).desc(), name).limit(1)


def _account_figures(accounts: DataFrame, subscriptions: DataFrame, m: int = 6) -> DataFrame:
    """One row: accounts, signup months, largest channel, retention after ``m`` months.

    One pass of the accounts and one of the records: an account's row carries
    its channel and signup through the join that retention needs.
    """
    open_then = (F.col("open_from") <= F.col("target")) & (F.col("open_to") >= F.col("target"))
    of_account = ("account_id", "referral_source", "signup_date", "target")
    eligible, active = F.col("target") <= F.col("last"), F.col("active")
    channel = F.struct("referral_source", "n")
    per_channel = (
        accounts.withColumn("target", month_number(F.col("signup_date")) + m)
        .select(*of_account)
        .join(account_spans(subscriptions), "account_id", "left")
        .groupBy(*of_account)
        .agg(F.bool_or(open_then).alias("active"))
        .withColumn("last", last_start_month(subscriptions))
        .groupBy("referral_source")
        .agg(
            F.count("*").alias("n"),
            F.min("signup_date").alias("first"),
            F.max("signup_date").alias("latest"),
            count_where(eligible).alias("eligible"),
            count_where(eligible & active).alias("kept"),
        )
    )
    return per_channel.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("accounts"),
        month_label(F.min("first")).alias("first_month"),
        month_label(F.max("latest")).alias("last_month"),
        pct(F.sum("kept"), F.sum("eligible")).alias("retention"),
        F.min_by(channel, F.struct(-F.col("n"), F.col("referral_source"))).alias("channel"),
    )


def _activity_figures(tickets: DataFrame, churn: DataFrame) -> DataFrame:
    """One row: churn totals, score missingness, resolution times; one pass of each table."""
    score = F.col("satisfaction_score")
    hours = hundredths(tickets, "resolution_time_hours")
    of_tickets = tickets.groupBy("account_id").agg(
        F.count("*").alias("tickets"),
        F.sum(hours).alias("hours"),
        F.count(hours).alias("with_hours"),
        F.count(score).alias("scored"),
        F.min(score).alias("least"),
        F.max(score).alias("most"),
    )
    of_churn = churn.groupBy("account_id").agg(
        F.count("*").alias("events"), count_where(F.col("is_reactivation")).alias("back")
    )
    churned = F.col("events").isNotNull()
    missing = F.sum("tickets") - F.sum("scored")
    return of_churn.join(of_tickets, "account_id", "full").agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_churn_events"),
        F.coalesce(F.sum("back"), F.lit(0)).alias("reactivation_events"),
        F.count(F.when(churned, F.col("account_id"))).alias("unique_churned_accounts"),
        count_where(F.col("events") > 1).alias("repeat_churn_accounts"),
        pct(missing, F.sum("tickets")).alias("pct_missing"),
        F.min("least").alias("min_observed_score"),
        F.max("most").alias("max_observed_score"),
        *[
            mean_half_up(sum_where(side, F.col("hours")), sum_where(side, F.col("with_hours")), 2, scale=2).alias(name)
            for name, side in (("churned", churned), ("others", ~churned))
        ],
    )


def business_summary(
    accounts: DataFrame,
    subscriptions: DataFrame,
    usage: DataFrame,
    tickets: DataFrame,
    churn: DataFrame,
) -> DataFrame:
    """Twelve headline rows: metric, value, comparison, context.

    Months and rates in the texts are computed from the data.  Every part is a
    one-row relation and enters as a scalar subquery.
    """
    features = usage.groupBy("feature_name").agg(F.sum("usage_count").alias("uses"))
    figures = _account_figures(accounts, subscriptions).withColumns(
        {
            "mrr": subscriptions.agg(latest_month_mrr(subscriptions)).scalar(),
            "mrr_month": month_label(month_start(last_start_month(subscriptions))),
            "trials": _row(conv_subscription_overall(subscriptions)),
            "feature": _row(_largest(features, "feature_name", "uses")),
            "activity": _row(_activity_figures(tickets, churn)),
        }
    )
    trials, activity = F.col("trials"), F.col("activity")
    accounts_n, unique = F.col("accounts"), activity.unique_churned_accounts
    # Values of the metric, value and comparison templates of each row.
    cells = {
        "accounts": ([F.col("first_month"), F.col("last_month")], [accounts_n], []),
        "channel": ([], [F.col("channel.referral_source")], [F.col("channel.n")]),
        "revenue": ([F.col("mrr_month")], [F.format_number(F.round("mrr"), 0)], []),
        "trials": (
            [],
            [trials.total_trial_subscription_records],
            [trials.trial_records_with_later_paid_record],
        ),
        "conversion": ([], [_decimals(trials.subscription_level_conversion_rate_pct, 1)], []),
        "retention": ([], [_decimals(F.col("retention"), 1)], []),
        "feature": ([], [F.col("feature.feature_name")], [F.col("feature.uses")]),
        "churn_events": ([], [activity.total_churn_events], [unique]),
        "churn_rate": ([], [_decimals(pct(unique, accounts_n), 1)], []),
        "repeat_churn": ([], [activity.repeat_churn_accounts], [activity.reactivation_events]),
        "satisfaction": (
            [],
            [_decimals(activity.pct_missing, 1)],
            [_decimals(activity.min_observed_score, 1), _decimals(activity.max_observed_score, 1)],
        ),
        "resolution": (
            [],
            [_decimals(activity.churned, 2)],
            [_decimals(activity.others, 2)],
        ),
    }
    rows = [
        F.struct(
            _filled(metric, cells[key][0]).alias("metric_name"),
            _filled(value, cells[key][1]).alias("metric_value"),
            _filled(comparison, cells[key][2]).alias("comparison_value"),
            F.lit(context).alias("context"),
        )
        for key, (metric, value, comparison, context) in SUMMARY_ROWS.items()
    ]
    return figures.select(F.inline(F.array(*rows)))


def summary_reconcile(
    accounts: DataFrame,
    churn: DataFrame,
    expected_accounts: int | Column,
    expected_events: int | Column,
    expected_churned: int | Column,
) -> DataFrame:
    """Whether the headline counts are the expected ones."""
    events = churn.agg(
        F.count("*").alias("events"), F.countDistinct("account_id").alias("churned")
    ).select(
        (F.col("events") == as_count(expected_events)).alias("churn_events_check"),
        (F.col("churned") == as_count(expected_churned)).alias("unique_churned_accounts_check"),
    )
    return (
        accounts.agg(F.count("*").alias("accounts"))
        .withColumn("events", _row(events))
        .select(
            (F.col("accounts") == as_count(expected_accounts)).alias("accounts_check"), "events.*"
        )
    )


def overview_headline(marts: Mapping[str, DataFrame]) -> DataFrame:
    """One row of headline figures read off the marts."""
    latest = marts["mrr_monthly"].agg(
        F.max_by(
            F.struct("month_label", "aggregate_subscription_mrr", "active_subscription_records"),
            "month_start",
        ).alias("latest")
    )
    month, rate = F.col("months_since_signup"), F.col("retention_rate_pct_eligible_cohorts_only")
    kept = marts["ret_pooled_curve"].agg(
        F.max(F.when(month == 0, rate)).alias("month_0"),
        F.max(F.when(month == 6, rate)).alias("month_6"),
    )
    return (
        marts["acq_monthly"]
        .agg(F.sum("new_accounts").alias("total_accounts"))
        .withColumns(
            {
                "churn": _row(marts["churn_repeat_summary"]),
                "trials": _row(marts["conv_subscription_overall"]),
                "latest": latest.scalar(),
                "kept": _row(kept),
            }
        )
        .select(
            "total_accounts",
            "churn.total_churn_events",
            "churn.unique_churned_accounts",
            "trials.subscription_level_conversion_rate_pct",
            F.col("latest.month_label").alias("latest_month"),
            F.col("latest.aggregate_subscription_mrr").alias("latest_month_mrr"),
            F.col("latest.active_subscription_records").alias("latest_month_records"),
            F.col("kept.month_0").alias("retention_month_0"),
            F.col("kept.month_6").alias("retention_month_6"),
        )
    )
