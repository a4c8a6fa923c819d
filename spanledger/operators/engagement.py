"""Feature usage by feature and by churn status, over whole account histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.functions.measures import mean_half_up, pct, rank_desc, ratio_half_up
from spanledger.plans.relations import churn_status, usage_per_account, usage_with_account


def _totals() -> dict[str, Column]:
    return {
        "events": F.count("*"),
        "uses": F.sum("usage_count"),
        "secs": F.sum("usage_duration_secs"),
        "errors": F.sum("error_count"),
    }


def usage_by_feature_account(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Usage totals per feature and account, the grain from which the feature tables are made."""
    return usage_per_account(usage, subscriptions, _totals(), by=["feature_name"])


def eng_top_features(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Features by total usage."""
    return top_features(usage_by_feature_account(usage, subscriptions))


def top_features(by_account: DataFrame) -> DataFrame:
    return (
        by_account.groupBy("feature_name")
        .agg(
            F.sum("events").alias("usage_events"),
            F.count("account_id").alias("distinct_accounts_using"),
            F.sum("uses").alias("total_usage_count"),
            F.sum("secs").alias("total_duration_secs"),
            mean_half_up(F.sum("secs"), F.sum("events"), 1).alias("avg_duration_secs_per_event"),
        )
        .withColumn("usage_volume_rank", rank_desc(F.col("total_usage_count")))
        .orderBy(F.col("total_usage_count").desc(), "feature_name")
    )


def eng_feature_errors(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Features by errors, with the error rate per use."""
    return (
        usage_with_account(usage, subscriptions)
        .groupBy("feature_name")
        .agg(
            F.sum("error_count").alias("total_errors"),
            F.sum("usage_count").alias("total_usage_count"),
        )
        .select(
            "feature_name",
            "total_errors",
            "total_usage_count",
            pct(F.col("total_errors"), F.col("total_usage_count"), 2).alias("error_rate_pct"),
            rank_desc(F.col("total_errors")).alias("error_count_rank"),
        )
        .orderBy(F.col("total_errors").desc(), "feature_name")
    )


def eng_beta_vs_ga(usage: DataFrame) -> DataFrame:
    """Beta against released features."""
    return (
        usage.groupBy("is_beta_feature", "feature_name")
        .agg(*[total.alias(name) for name, total in _totals().items()])
        .groupBy("is_beta_feature")
        .agg(
            F.count("feature_name").alias("distinct_features"),
            F.sum("events").alias("usage_events"),
            F.sum("uses").alias("total_usage_count"),
            F.sum("errors").alias("total_errors"),
        )
        .withColumn("error_rate_pct", pct(F.col("total_errors"), F.col("total_usage_count"), 2))
        .orderBy("is_beta_feature")
    )


def eng_feature_by_churn(
    usage: DataFrame, subscriptions: DataFrame, churn: DataFrame
) -> DataFrame:
    """Usage per feature of churned and other accounts."""
    accounts = F.count("account_id")
    return (
        churn_status(usage_by_feature_account(usage, subscriptions), churn)
        .groupBy("feature_name", "is_churned_account")
        .agg(
            accounts.alias("distinct_accounts"),
            F.sum("uses").alias("total_usage_count"),
            mean_half_up(F.sum("uses"), F.sum("events"), 2).alias("avg_usage_count_per_event"),
            ratio_half_up(F.sum("uses"), accounts, 2).alias("usage_per_account"),
        )
        .orderBy("feature_name", "is_churned_account")
    )


def eng_summary_by_churn(
    usage: DataFrame, subscriptions: DataFrame, churn: DataFrame
) -> DataFrame:
    """Usage per account of churned and other accounts."""
    return summary_by_churn(usage_per_account(usage, subscriptions, _totals()), churn)


def summary_by_churn(by_account: DataFrame, churn: DataFrame) -> DataFrame:
    accounts = F.count("account_id")
    return (
        churn_status(by_account, churn)
        .groupBy("is_churned_account")
        .agg(
            accounts.alias("accounts"),
            F.sum("events").alias("usage_events"),
            ratio_half_up(F.sum("events"), accounts, 1).alias("usage_events_per_account"),
            ratio_half_up(F.sum("uses"), accounts, 1).alias("usage_count_per_account"),
            ratio_half_up(F.sum("errors"), accounts, 2).alias("errors_per_account"),
        )
        .orderBy("is_churned_account")
    )


def eng_reconcile(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Features, and usage rows that survive the join to their record."""
    return (
        usage_with_account(usage, subscriptions)
        .groupBy("feature_name")
        .agg(F.count("*").alias("events"))
        .agg(
            F.count("feature_name").alias("distinct_features"),
            F.coalesce(F.sum("events"), F.lit(0)).alias("total_usage_events_after_join"),
        )
    )


def eng_top_n(top_features: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most used features and how far the last lies below the first, in percent."""
    uses, everything = F.col("total_usage_count"), Window.partitionBy()
    most, least = F.max(uses).over(everything), F.min(uses).over(everything)
    return (
        top_features.select("feature_name", "total_usage_count")
        .orderBy(uses.desc(), "feature_name")
        .limit(n)
        .withColumn("spread_pct", 100 * (most - least) / F.nullif(most, F.lit(0)))
    )


def eng_churn_gap(by_churn: DataFrame) -> DataFrame:
    """Relative difference in usage per account between churned and other accounts."""
    churned, uses = F.col("is_churned_account"), F.col("usage_count_per_account")
    return by_churn.agg(
        F.max(F.when(churned, uses)).alias("churned_usage_per_account"),
        F.max(F.when(~churned, uses)).alias("non_churned_usage_per_account"),
    ).withColumn(
        "diff_pct",
        100
        * F.abs(F.col("churned_usage_per_account") - F.col("non_churned_usage_per_account"))
        / F.nullif(F.col("non_churned_usage_per_account"), F.lit(0.0)),
    )
