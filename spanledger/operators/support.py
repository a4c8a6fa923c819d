"""Support activity of churned and other accounts; associations, not causes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.measures import (
    count_where,
    hundredths,
    mean_half_up,
    pct,
    ratio_half_up,
)
from spanledger.plans.relations import churn_status
from spanledger.schema import PRIORITIES


def tickets_per_account(
    tickets: DataFrame, by: Sequence[str] = (), priorities: Sequence[str] = PRIORITIES
) -> DataFrame:
    """Ticket totals per account, the grain at which churn status is joined.

    Every measure of the churn comparisons adds up from here; those an operator
    does not use are pruned from its plan.
    """
    hours = hundredths(tickets, "resolution_time_hours")
    minutes = F.col("first_response_time_minutes")
    score = hundredths(tickets, "satisfaction_score")
    return tickets.groupBy("account_id", *by).agg(
        F.count("*").alias("tickets"),
        F.sum(hours).alias("hours"),
        F.count(hours).alias("with_hours"),
        F.sum(minutes).alias("minutes"),
        F.count(minutes).alias("with_minutes"),
        F.sum(score).alias("score"),
        F.count(score).alias("with_score"),
        count_where(F.col("escalation_flag")).alias("escalated"),
        *[count_where(F.col("priority") == p).alias(f"priority_{p}") for p in priorities],
    )


def _avg_hours() -> Column:
    return mean_half_up(F.sum("hours"), F.sum("with_hours"), 2, scale=2)


def _avg_minutes() -> Column:
    return mean_half_up(F.sum("minutes"), F.sum("with_minutes"), 1)


def sup_volume_by_churn(tickets: DataFrame, churn: DataFrame) -> DataFrame:
    """Ticket volume, speed and escalation by churn status."""
    total, accounts = F.sum("tickets"), F.count("account_id")
    return (
        churn_status(tickets_per_account(tickets), churn)
        .groupBy("is_churned_account")
        .agg(
            accounts.alias("accounts"),
            total.alias("tickets"),
            ratio_half_up(total, accounts, 2).alias("tickets_per_account"),
            _avg_hours().alias("avg_resolution_time_hours"),
            _avg_minutes().alias("avg_first_response_minutes"),
            F.sum("escalated").alias("escalated_tickets"),
            pct(F.sum("escalated"), total).alias("escalation_rate_pct"),
        )
        .orderBy("is_churned_account")
    )


def sup_priority_mix(
    tickets: DataFrame, churn: DataFrame, pressing: Sequence[str] = ("high", "urgent")
) -> DataFrame:
    """Tickets per priority by churn status."""
    total = F.sum("tickets")
    pressed = sum((F.sum(f"priority_{p}") for p in pressing), F.lit(0))
    return (
        churn_status(tickets_per_account(tickets), churn)
        .groupBy("is_churned_account")
        .agg(
            *[F.sum(f"priority_{p}").alias(f"{p}_priority_tickets") for p in PRIORITIES],
            total.alias("total_tickets"),
            pct(pressed, total).alias(f"pct_{'_or_'.join(pressing)}"),
        )
        .orderBy("is_churned_account")
    )


def sup_resolution_by_priority(tickets: DataFrame, churn: DataFrame) -> DataFrame:
    """Speed per priority and churn status."""
    return (
        churn_status(tickets_per_account(tickets, by=["priority"]), churn)
        .groupBy("priority", "is_churned_account")
        .agg(
            F.sum("tickets").alias("tickets"),
            _avg_hours().alias("avg_resolution_time_hours"),
            _avg_minutes().alias("avg_first_response_minutes"),
        )
        .orderBy("priority", "is_churned_account")
    )


def sup_satisfaction(tickets: DataFrame, churn: DataFrame) -> DataFrame:
    """Scores by churn status, with how many are missing beside the biased mean."""
    total, scored = F.sum("tickets"), F.sum("with_score")
    return (
        churn_status(tickets_per_account(tickets), churn)
        .groupBy("is_churned_account")
        .agg(
            total.alias("total_tickets"),
            scored.alias("tickets_with_score"),
            (total - scored).alias("tickets_missing_score"),
            pct(total - scored, total).alias("pct_missing_score"),
            mean_half_up(F.sum("score"), scored, 2, scale=2).alias(
                "avg_observed_score_biased_sample"
            ),
        )
        .orderBy("is_churned_account")
    )


def sup_reconcile(tickets: DataFrame, churn: DataFrame) -> DataFrame:
    """Tickets directly and through the churn split, and accounts with a ticket."""
    split = sup_volume_by_churn(tickets, churn).agg(F.sum("tickets"))
    return tickets.agg(
        F.count("*").alias("total_tickets_actual"),
        F.countDistinct("account_id").alias("distinct_accounts_with_tickets"),
    ).select(
        "total_tickets_actual",
        split.scalar().alias("total_via_split"),
        "distinct_accounts_with_tickets",
    )
