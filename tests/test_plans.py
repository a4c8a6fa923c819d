"""What physical plans must not contain, and what must reach the scan."""

from __future__ import annotations

import re

import pytest
from star import STAR

from spanledger.operators import engagement
from spanledger.registry import OPERATORS, query

FORBIDDEN = (
    "BroadcastNestedLoopJoin",
    "CartesianProduct",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroupsInPandas",
)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(OPERATORS))
@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_no_pair_joins_and_no_python(spark, name, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        plan = plan_of(query(name)(spark, STAR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [operator for operator in FORBIDDEN if operator in plan]


def scans(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet.*?{table}\.parquet", plan))


@pytest.fixture
def as_planned(spark):
    """Plans as they run without adaptive changes and without broadcasts."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("name", ["mrr_monthly", "mrr_by_plan", "mrr_trial_paid"])
def test_monthly_revenue_is_one_pass_of_the_records(as_planned, name):
    """Records are combined per month before the only exchange that grows with nothing else."""
    plan = plan_of(query(name)(as_planned, STAR))
    assert "Join" not in plan and scans(plan, "orders") == 1
    keys = re.findall(r"hashpartitioning\(([^,]+),", plan)
    assert keys and all("month_no" in key or "groupingexpression" in key for key in keys)


@pytest.mark.parametrize(
    ("name", "orders", "events"),
    [
        ("conv_subscription_overall", 1, 0),
        ("conv_subscription_by_plan", 1, 0),
        ("business_summary", 6, 1),
        ("overview_headline", 6, 0),
    ],
)
def test_tables_are_scanned_no_more_often_than_needed(as_planned, name, orders, events):
    plan = plan_of(query(name)(as_planned, STAR))
    assert scans(plan, "orders") <= orders and scans(plan, "events") <= events


def test_scans_read_only_the_columns_they_use(spark):
    plan = plan_of(query("acq_by_plan")(spark, STAR))
    assert "orders.parquet" not in plan and "nation.parquet" not in plan
    assert re.search(r"ReadSchema: struct<c_acctbal:double>", plan)


def test_churn_filter_reaches_the_scan_of_the_events(spark):
    plan = plan_of(query("churn_refund_total")(spark, STAR))
    assert "PushedFilters: [IsNotNull(o_orderkey)]" in plan
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>", plan)


def test_usage_per_account_is_combined_per_record_before_the_join(as_planned):
    plan = plan_of(query("eng_summary_by_churn")(as_planned, STAR))
    above = plan[: plan.index("lineitem.parquet")]
    assert above.rindex("HashAggregate(keys=[subscription_id") > above.rindex("SortMergeJoin")


@pytest.mark.parametrize(
    "name",
    ["eng_top_features", "eng_feature_errors", "eng_feature_by_churn", "eng_reconcile", "eng_top_n", "dq11_usage_in_window"],
)
def test_usage_by_feature_or_day_moves_once_before_the_join(as_planned, name):
    plan = plan_of(query(name)(as_planned, STAR))
    above = plan[: plan.index("lineitem.parquet")]
    assert "HashAggregate" not in above[above.rindex("SortMergeJoin") :]


def test_a_hot_record_is_split_over_tasks(spark, tmp_path):
    usage = spark.range(400_000, numPartitions=16).selectExpr(
        "if(id % 3 = 0, 7, id % 5000) AS subscription_id",
        "concat('f', id % 40) AS feature_name",
        "int(id % 9) AS usage_count",
        "int(id % 7) AS usage_duration_secs",
        "int(id % 2) AS error_count",
    )
    usage.write.parquet(f"{tmp_path}/usage")
    records = spark.range(5000).selectExpr("id AS subscription_id", "id % 900 AS account_id")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        result = engagement.eng_top_features(spark.read.parquet(f"{tmp_path}/usage"), records)
        rows = result.collect()
        plan = plan_of(result)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    assert "SortMergeJoin(skew=true)" in plan
    assert sum(r.usage_events for r in rows) == 400_000


def test_categories_are_counted_in_one_pass_of_each_table(as_planned):
    plan = plan_of(query("dq15_category_inventory")(as_planned, STAR))
    assert scans(plan, "customer") == 1 and scans(plan, "events") == 1
