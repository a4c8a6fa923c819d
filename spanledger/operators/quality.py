"""Data-quality checks, generic over tables and columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.measures import count_where, mean_half_up, pct, share_of_total
from spanledger.plans.relations import churn_status, events_per_account
from spanledger.schema import CATEGORY_FIELDS, FOREIGN_KEYS, PRIMARY_KEYS

Tables = Mapping[str, DataFrame]

# Buckets of days from signup to the first record, by their last day.
SIGNUP_GAPS = (
    (-1, "before signup"),
    (0, "same day as signup"),
    (30, "1-30 days after signup"),
    (90, "31-90 days after signup"),
)
LONGER_GAP = "90+ days after signup"

# Names of the date checks.
END_BEFORE_START = "subscription end before start"
CLOSED_BEFORE_SUBMITTED = "ticket closed before submitted"
CHURN_BEFORE_SIGNUP = "churn event before account signup"
START_BEFORE_SIGNUP = "subscription starts before account signup"


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def as_count(expected: int | Column) -> Column:
    """An expected number, given as such or as a scalar subquery."""
    return (expected if isinstance(expected, Column) else F.lit(expected)).cast("bigint")


def dq01_row_counts(tables: Tables, expected: Mapping[str, int | Column]) -> DataFrame:
    """Actual against expected rows of each expected table."""
    return _stack(
        [
            tables[name]
            .agg(F.count("*").alias("actual_rows"))
            .select(
                F.lit(f"raw_{name}").alias("table_name"),
                "actual_rows",
                as_count(rows).alias("expected_rows"),
            )
            for name, rows in expected.items()
        ]
    )


def dq02_key_uniqueness(tables: Tables, keys: Mapping[str, str] = PRIMARY_KEYS) -> DataFrame:
    """Rows against distinct values of each declared key."""
    return _stack(
        [
            tables[name]
            .groupBy(key)
            .agg(F.count("*").alias("n"))
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
                F.count(key).alias("distinct_values"),
            )
            .select(
                F.lit(f"raw_{name}.{key}").alias("key_column"), "total_rows", "distinct_values"
            )
            for name, key in keys.items()
        ]
    )


def _occurrences(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("occurrences"))


def dq03_duplicate_keys(usage: DataFrame, key: str = "usage_id") -> DataFrame:
    """Values of ``key`` held by more than one row, most frequent first."""
    return (
        _occurrences(usage, key)
        .filter("occurrences > 1")
        .orderBy(F.col("occurrences").desc(), key)
    )


def dq03_duplicate_summary(usage: DataFrame, key: str = "usage_id") -> DataFrame:
    """How many key values repeat and how many rows are surplus."""
    return (
        _occurrences(usage, key)
        .filter("occurrences > 1")
        .agg(
            F.count("*").alias(f"duplicated_{key}s"),
            F.sum(F.col("occurrences") - 1).alias("surplus_rows"),
        )
    )


def dq04_fk_orphans(
    tables: Tables, relationships: Sequence[tuple[str, str, str]] = FOREIGN_KEYS
) -> DataFrame:
    """Rows per (child, parent, key) whose parent is missing.

    The child is counted per key before the anti join, so a key held by very
    many rows is one row in it.  A NULL key has no parent and is an orphan.
    """
    return _stack(
        [
            tables[child]
            .groupBy(key)
            .agg(F.count("*").alias("n"))
            .join(tables[parent].select(key), key, "left_anti")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"))
            .select(F.lit(f"{child} -> {parent}").alias("relationship"), "orphan_rows")
            for child, parent, key in relationships
        ]
    )


def _open_per_account(subscriptions: DataFrame) -> DataFrame:
    return (
        subscriptions.filter(F.col("end_date").isNull())
        .groupBy("account_id")
        .agg(F.count("*").alias("open_sub_count"))
    )


def dq05_open_sub_histogram(subscriptions: DataFrame) -> DataFrame:
    """Accounts per number of open records."""
    return (
        _open_per_account(subscriptions)
        .groupBy("open_sub_count")
        .agg(F.count("*").alias("accounts_with_this_many_open_subs"))
        .orderBy("open_sub_count")
    )


def dq05_open_sub_summary(subscriptions: DataFrame) -> DataFrame:
    """Least, mean and most open records over accounts that have one."""
    n = F.col("open_sub_count")
    return _open_per_account(subscriptions).agg(
        F.min(n).alias("min_open_subs_per_account"),
        mean_half_up(F.sum(n), F.count(n), 2).alias("avg_open_subs_per_account"),
        F.max(n).alias("max_open_subs_per_account"),
    )


def dq06_open_rate(subscriptions: DataFrame) -> DataFrame:
    """Share of records without an end date."""
    is_open = count_where(F.col("end_date").isNull())
    return subscriptions.agg(
        F.count("*").alias("total_subscriptions"),
        is_open.alias("open_subscriptions"),
        pct(is_open, F.count("*")).alias("pct_open"),
    )


def dq07_derived_column(subscriptions: DataFrame) -> DataFrame:
    """Rows whose yearly amount is not twelve monthly amounts."""
    return subscriptions.agg(
        count_where(F.col("arr_amount") != F.col("mrr_amount") * 12).alias("mismatched_arr_rows")
    )


def dq08_trial_vs_zero_mrr(subscriptions: DataFrame) -> DataFrame:
    return (
        subscriptions.groupBy("is_trial", (F.col("mrr_amount") == 0).alias("mrr_is_zero"))
        .agg(F.count("*").alias("row_count"))
        .orderBy("is_trial", "mrr_is_zero")
    )


def dq08_churn_flag_vs_end(subscriptions: DataFrame) -> DataFrame:
    return (
        subscriptions.groupBy("churn_flag", F.col("end_date").isNotNull().alias("has_end_date"))
        .agg(F.count("*").alias("row_count"))
        .orderBy("churn_flag", "has_end_date")
    )


def dq09_flag_vs_events(accounts: DataFrame, churn: DataFrame) -> DataFrame:
    """Account churn flag against the presence of churn events."""
    return (
        churn_status(accounts.select("account_id", "churn_flag"), churn)
        .groupBy(
            F.col("churn_flag").alias("account_churn_flag"),
            F.col("is_churned_account").alias("has_any_churn_event"),
        )
        .agg(F.count("*").alias("account_count"))
        .orderBy("account_churn_flag", "has_any_churn_event")
    )


def dq10_events_per_account(churn: DataFrame) -> DataFrame:
    """Accounts per number of churn events."""
    return (
        events_per_account(churn)
        .groupBy("events_per_account")
        .agg(F.count("*").alias("accounts_with_this_many_events"))
        .orderBy("events_per_account")
    )


def dq11_usage_in_window(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Usage rows dated inside the window of their subscription record.

    Counting per record and day first would combine next to nothing and cost a shuffle.
    """
    windows = subscriptions.select("subscription_id", "start_date", "end_date")
    inside = (F.col("usage_date") >= F.col("start_date")) & (
        F.col("end_date").isNull() | (F.col("usage_date") <= F.col("end_date"))
    )
    return (
        usage.select("subscription_id", "usage_date")
        .join(windows, "subscription_id")
        .agg(
            F.count("*").alias("total_usage_rows"),
            count_where(inside).alias("rows_inside_subscription_window"),
        )
        .withColumn(
            "pct_inside_window",
            pct(F.col("rows_inside_subscription_window"), F.col("total_usage_rows")),
        )
    )


def dq12_score_missingness(tickets: DataFrame, column: str = "satisfaction_score") -> DataFrame:
    """How many tickets have no score, and the range of the scores there are."""
    missing = count_where(F.col(column).isNull())
    return tickets.agg(
        F.count("*").alias("total_tickets"),
        F.count(column).alias("tickets_with_score"),
        missing.alias("tickets_missing_score"),
        pct(missing, F.count("*")).alias("pct_missing"),
        F.min(column).alias("min_observed_score"),
        F.max(column).alias("max_observed_score"),
    )


def dq13_feedback_missingness(churn: DataFrame, column: str = "feedback_text") -> DataFrame:
    """How many churn events carry no feedback."""
    missing = count_where(F.col(column).isNull())
    return churn.agg(
        F.count("*").alias("total_churn_events"),
        F.count(column).alias("events_with_feedback"),
        missing.alias("events_missing_feedback"),
        pct(missing, F.count("*")).alias("pct_missing"),
    )


def _before_signup(accounts: DataFrame, df: DataFrame, date: str) -> DataFrame:
    per_day = df.groupBy("account_id", date).agg(F.count("*").alias("n"))
    return (
        per_day.join(accounts.select("account_id", "signup_date"), "account_id")
        .filter(F.col(date) < F.col("signup_date"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violation_count"))
    )


def dq14_impossible_dates(
    accounts: DataFrame, subscriptions: DataFrame, tickets: DataFrame, churn: DataFrame
) -> DataFrame:
    """Rows whose dates cannot be right, per rule."""
    n = F.count("*").alias("violation_count")
    checks = {
        END_BEFORE_START: subscriptions.filter("end_date < start_date").agg(n),
        CLOSED_BEFORE_SUBMITTED: tickets.filter("closed_at < submitted_at").agg(n),
        CHURN_BEFORE_SIGNUP: _before_signup(accounts, churn, "churn_date"),
        START_BEFORE_SIGNUP: _before_signup(accounts, subscriptions, "start_date"),
    }
    return _stack(
        [df.select(F.lit(name).alias("check_name"), "violation_count") for name, df in checks.items()]
    )


def dq15_category_inventory(
    tables: Tables, fields: Sequence[tuple[str, str, str]] = CATEGORY_FIELDS
) -> DataFrame:
    """Every value of each (label, table, column) with its rows; one pass of each table."""
    of_table: dict[str, list[Column]] = {}
    for label, table, column in fields:
        field = F.struct(F.lit(label).alias("field"), F.col(column).alias("value"))
        of_table.setdefault(table, []).append(field)
    return _stack(
        [
            tables[table]
            .select(F.explode(F.array(*values)).alias("of"))
            .groupBy(F.col("of.field").alias("field"), F.col("of.value").alias("value"))
            .agg(F.count("*").alias("row_count"))
            for table, values in of_table.items()
        ]
    ).orderBy("field", "value")


def dq16_signup_gap_buckets(accounts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Accounts by days from signup to their first subscription record."""
    first = subscriptions.groupBy("account_id").agg(F.min("start_date").alias("first_start"))
    gap = F.datediff("first_start", "signup_date")
    bucket = F.coalesce(
        *[F.when(gap <= last_day, label) for last_day, label in SIGNUP_GAPS], F.lit(LONGER_GAP)
    )
    return (
        accounts.select("account_id", "signup_date")
        .join(first, "account_id")
        .groupBy(bucket.alias("gap_bucket"))
        .agg(F.count("*").alias("accounts"))
        .withColumn("pct_of_accounts", share_of_total(F.col("accounts")))
        .orderBy(F.col("accounts").desc(), "gap_bucket")
    )
