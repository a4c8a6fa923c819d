"""Lifecycle tables derived from an order star schema (customer, orders, lineitem, events).

The order tables carry no subscription data, so a fixed mapping stands in for
it: a customer is an account, an order a subscription record, an order line a
usage event, an event a support ticket, and every ninth order a churn event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SOURCE_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SOURCE_SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def accounts(
    spark: SparkSession, folder: str, signup: bool = True, country: bool = True
) -> DataFrame:
    """Accounts, one per customer; a customer of an unknown nation has no country.

    ``signup=False`` leaves out ``signup_date`` and with it the scan of orders,
    ``country=False`` the country and with it the join with the nations.
    """
    customers = _source(spark, folder, "customer")
    columns = [
        "c_custkey AS account_id",
        "c_name AS account_name",
        "c_mktsegment AS industry",
        "element_at(array('organic', 'other', 'ads', 'event', 'partner'), c_nationkey % 5 + 1) AS referral_source",
        "CASE floor(abs(c_acctbal)) % 3 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Pro' ELSE 'Enterprise' END AS plan_tier",
        "int(1 + c_custkey % 50) AS seats",
        "c_custkey % 5 = 0 AS is_trial",
        "c_custkey % 4 = 0 AS churn_flag",
    ]
    if country:
        nation = _source(spark, folder, "nation").selectExpr(
            "n_nationkey AS c_nationkey", "n_name AS country"
        )
        customers = customers.join(nation, "c_nationkey", "left")
        columns.insert(3, "country")
    if signup:
        first_order = (
            _source(spark, folder, "orders")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.min("o_orderdate").alias("first_order"))
        )
        customers = customers.join(first_order, "c_custkey", "left")
        columns.append(
            "date_sub(coalesce(date(first_order), date '1995-01-01'), int(c_custkey % 430)) AS signup_date"
        )
    return customers.selectExpr(*columns)


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    mrr = "if(o_orderpriority = '5-LOW', 0, floor(o_totalprice / 100))"
    return _source(spark, folder, "orders").selectExpr(
        "o_orderkey AS subscription_id",
        "o_custkey AS account_id",
        "date(o_orderdate) AS start_date",
        "if(o_orderkey % 10 = 0, date_add(date(o_orderdate), int(o_orderkey % 365)), NULL) AS end_date",
        "CASE o_orderstatus WHEN 'F' THEN 'Basic' WHEN 'O' THEN 'Pro' ELSE 'Enterprise' END AS plan_tier",
        "int(1 + o_orderkey % 50) AS seats",
        f"cast({mrr} AS decimal(12,2)) AS mrr_amount",
        f"cast(12 * {mrr} AS decimal(12,2)) AS arr_amount",
        "o_orderpriority = '5-LOW' AS is_trial",
        "o_orderkey % 7 = 0 AS upgrade_flag",
        "o_orderkey % 11 = 0 AS downgrade_flag",
        "o_orderkey % 10 = 0 AS churn_flag",
        "if(o_orderkey % 2 = 0, 'monthly', 'annual') AS billing_frequency",
        "o_orderkey % 5 <> 0 AS auto_renew_flag",
    )


def feature_usage(spark: SparkSession, folder: str) -> DataFrame:
    return _source(spark, folder, "lineitem").selectExpr(
        "concat('U', l_orderkey, '-', l_linenumber) AS usage_id",
        "l_orderkey AS subscription_id",
        "date(l_shipdate) AS usage_date",
        "concat('feature_', l_partkey % 40 + 1) AS feature_name",
        "int(l_quantity) AS usage_count",
        "int(floor(l_extendedprice / 10)) AS usage_duration_secs",
        "if(l_partkey % 7 = 0, l_linenumber, 0) AS error_count",
        "l_returnflag = 'R' AS is_beta_feature",
    )


def support_tickets(spark: SparkSession, folder: str) -> DataFrame:
    return _source(spark, folder, "events").selectExpr(
        "event_id AS ticket_id",
        "user_id AS account_id",
        "ts AS submitted_at",
        "timestampadd(MINUTE, int(floor(value * 60)), ts) AS closed_at",
        "cast(value AS decimal(10,2)) AS resolution_time_hours",
        "CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'medium' "
        "WHEN 'signup' THEN 'high' ELSE 'urgent' END AS priority",
        "int(event_id % 180) AS first_response_time_minutes",
        "if(event_id % 5 < 2, NULL, cast(3 + event_id % 3 AS decimal(3,1))) AS satisfaction_score",
        "event_id % 20 = 0 AS escalation_flag",
    )


def churn_events(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _source(spark, folder, "orders")
        .filter("o_orderkey % 9 = 4")
        .selectExpr(
            "o_orderkey AS churn_event_id",
            "o_custkey AS account_id",
            "date_add(date(o_orderdate), int(o_orderkey % 90)) AS churn_date",
            "CASE floor(o_totalprice) % 6 WHEN 0 THEN 'features' WHEN 1 THEN 'budget' "
            "WHEN 2 THEN 'support' WHEN 3 THEN 'unknown' WHEN 4 THEN 'competitor' "
            "ELSE 'pricing' END AS reason_code",
            "cast(if(o_orderkey % 2 = 0, floor(o_totalprice / 1000), 0) AS decimal(10,2)) AS refund_amount_usd",
            "o_orderkey % 7 = 0 AS preceding_upgrade_flag",
            "o_orderkey % 11 = 0 AS preceding_downgrade_flag",
            "o_orderkey % 10 = 0 AS is_reactivation",
            "if(o_orderkey % 4 = 0, NULL, o_orderpriority) AS feedback_text",
        )
    )


def expected_counts(spark: SparkSession, folder: str) -> dict[str, Column]:
    """Rows that each lifecycle table must have, and churned accounts, told from the order tables."""
    churning = "o_orderkey % 9 = 4"
    counts = {
        name: _source(spark, folder, source).agg(F.count(key)).scalar()
        for name, source, key in (
            ("accounts", "customer", "c_custkey"),
            ("subscriptions", "orders", "o_orderkey"),
            ("feature_usage", "lineitem", "l_orderkey"),
            ("support_tickets", "events", "event_id"),
        )
    }
    orders = _source(spark, folder, "orders")
    counts["churn_events"] = orders.agg(F.expr(f"count_if({churning})")).scalar()
    counts["churned_accounts"] = orders.agg(F.expr(f"count(DISTINCT if({churning}, o_custkey, NULL))")).scalar()
    return counts


def lifecycle_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five lifecycle tables, lazily."""
    return {
        "accounts": accounts(spark, folder),
        "subscriptions": subscriptions(spark, folder),
        "feature_usage": feature_usage(spark, folder),
        "support_tickets": support_tickets(spark, folder),
        "churn_events": churn_events(spark, folder),
    }
