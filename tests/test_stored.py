"""Stored steps, histories and buckets give what a run over everything gives, and read less."""

from __future__ import annotations

import re

import pytest
from edge_tables import edge_tables
from pyspark.sql import functions as F
from star import STAR
from test_plans import plan_of, scans

from spanledger.operators import acquisition, churn, engagement, quality, retention, revenue, value
from spanledger.plans.history import store_history
from spanledger.plans.spine import calendar_month_spine
from spanledger.registry import StarInputs
from spanledger.schema import TABLES
from spanledger.sources.buckets import by_record
from spanledger.sources.raw import read_raw, rejected_counts, rejected_rows
from spanledger.sources.step_ledger import StepLedger


@pytest.fixture(scope="module")
def star(spark):
    return StarInputs(spark, STAR)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("edge_case", [False, True])
def test_base_and_batches_equal_the_full_build(spark, star, edge, tmp_path, edge_case):
    inputs = edge[0] if edge_case else star
    ledger = StepLedger(spark, str(tmp_path))
    parts = [F.pmod(F.xxhash64(k), F.lit(3)) for k in ("subscription_id", "account_id", "churn_event_id")]
    for n in range(3):
        ledger.append(
            f"day{n}",
            subscriptions=inputs.subscriptions.filter(parts[0] == n),
            accounts=inputs.accounts.filter(parts[1] == n),
            churn=inputs.churn.filter(parts[2] == n),
        )
    # A batch written again replaces itself.
    ledger.append("day1", accounts=inputs.accounts.filter(parts[1] == 1))
    spine = inputs.spine
    assert rows(ledger.mrr_monthly(spine)) == rows(revenue.mrr_monthly(inputs.subscriptions, spine))
    assert rows(ledger.mrr_monthly()) == rows(revenue.mrr_monthly(inputs.subscriptions))
    assert rows(ledger.mrr_by_plan(spine)) == rows(revenue.mrr_by_plan(inputs.subscriptions, spine))
    assert rows(ledger.acq_monthly(spine)) == rows(acquisition.acq_monthly(inputs.accounts, spine))
    assert rows(ledger.churn_monthly(spine)) == rows(churn.churn_monthly(inputs.churn, spine))
    plan = plan_of(ledger.mrr_by_plan())
    assert "orders.parquet" not in plan


def test_a_new_version_of_a_record_takes_its_old_steps_back(spark, star, tmp_path):
    records = star.subscriptions
    open_then = records.withColumn("end_date", F.lit(None).cast("date"))
    ended = records.filter("end_date IS NOT NULL")
    ledger = StepLedger(spark, str(tmp_path))
    ledger.append("base", subscriptions=open_then)
    was_open = open_then.join(ended.select("subscription_id"), "subscription_id", "left_semi").select(*records.columns)
    ledger.append("ends", subscriptions=ended, replaced=was_open)
    assert rows(ledger.mrr_monthly()) == rows(revenue.mrr_monthly(records))
    assert rows(ledger.mrr_by_plan()) == rows(revenue.mrr_by_plan(records))


def test_an_empty_ledger_says_so(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        StepLedger(spark, str(tmp_path / "none")).mrr_monthly()


@pytest.mark.parametrize("case", ["star", "edge", "empty"])
def test_a_stored_history_gives_the_same_results(spark, star, edge, empty, tmp_path, case):
    inputs = {"star": star, "edge": edge[0], "empty": empty[0]}[case]
    accounts, records, spine = inputs.accounts, inputs.subscriptions, inputs.spine
    history = store_history(records, f"{tmp_path}/history")
    for results in (
        lambda source: retention.ret_matrix(accounts, source, spine),
        lambda source: retention.ret_matrix(accounts, source, spine, None, cap_to_observed=True),
        lambda source: retention.ret_pooled_curve(accounts, source),
        lambda source: retention.ret_month_m_check(accounts, source, 6),
        lambda source: retention.ret_active_in_signup_month(accounts, source),
        lambda source: value.value_by_cohort(accounts, source, spine),
        lambda source: value.value_by_cohort(accounts, source, spine, cap_to_observed=True),
    ):
        assert rows(results(history)) == rows(results(records))


def test_readers_of_a_history_scan_no_records(spark, star, tmp_path):
    for name in ("accounts", "spine"):
        getattr(star, name).write.parquet(f"{tmp_path}/{name}")
    accounts, spine = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("accounts", "spine"))
    history = store_history(star.subscriptions, f"{tmp_path}/history")
    for result in (
        retention.ret_matrix(accounts, history, spine, cap_to_observed=True),
        retention.ret_pooled_curve(accounts, history),
        retention.ret_month_m_check(accounts, history),
        value.value_by_cohort(accounts, history, spine),
    ):
        assert scans(plan_of(result), "orders") == 0


def test_bucketed_usage_is_joined_where_it_lies(spark, star, tmp_path):
    usage, records = by_record(star.usage, star.subscriptions, "test_buckets", 8)
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, setting in settings.items():
        spark.conf.set(key, setting)
    try:
        for operator in (
            engagement.eng_top_features,
            engagement.eng_feature_errors,
            quality.dq11_usage_in_window,
            engagement.usage_by_feature_account,
        ):
            result = operator(usage, records)
            plan = plan_of(result)
            below = plan[plan.index("SortMergeJoin") :]
            assert not re.search(r"Exchange hashpartitioning\(subscription_id", below), operator.__name__
            assert rows(result.orderBy(*result.columns)) == rows(
                (plain := operator(star.usage, star.subscriptions)).orderBy(*plain.columns)
            )
    finally:
        for key, setting in before.items():
            spark.conf.set(key, setting)
        for table in ("usage", "records"):
            spark.sql(f"DROP TABLE IF EXISTS test_buckets_{table}")


def test_months_and_counts_come_from_footers(spark, tmp_path):
    for name, df in edge_tables(spark).items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    tables = read_raw(spark, str(tmp_path), fmt="parquet")
    plain = {name: spark.read.schema(TABLES[name]).parquet(f"{tmp_path}/{name}.parquet") for name in TABLES}

    def spine_of(of):
        return calendar_month_spine(of["accounts"], of["subscriptions"], of["feature_usage"], of["churn_events"])

    spine = spine_of(tables)
    plan = plan_of(spine)
    for pushed in ("MIN(signup_date)", "MAX(signup_date)", "MAX(usage_date)", "MAX(churn_date)"):
        assert re.search(rf"PushedAggregation: \[[^\]]*{re.escape(pushed)}", plan), pushed
    assert rows(spine) == rows(spine_of(plain))
    counted = tables["feature_usage"].agg(F.count("*"))
    assert "PushedAggregation: [COUNT(*)]" in plan_of(counted)
    # End dates may be missing from a whole file, where footers hold no extremes: those are scanned.
    assert "PushedAggregation" not in plan_of(tables["subscriptions"].agg(F.max("end_date")))
    assert tables["subscriptions"].agg(F.max("end_date")).first() == plain["subscriptions"].agg(F.max("end_date")).first()
    assert counted.first()[0] == plain["feature_usage"].count()


def test_bad_lines_are_written_beside(spark, tmp_path):
    from test_sources import _write_csv

    _write_csv(tmp_path)
    good = read_raw(spark, str(tmp_path))
    path = tmp_path / "churn_events.csv"
    bad = "ev-x,acc-1,not a date,features,1.00,true,false,false,text"
    path.write_text(path.read_text() + bad + "\n" + bad.replace("not a date", "2023-01-01").replace("1.00", "much") + "\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        read_raw(spark, str(tmp_path))["churn_events"].collect()
    tables = read_raw(spark, str(tmp_path), rejected=str(tmp_path / "rejected"))
    for name in TABLES:
        assert tables[name].schema.names == good[name].schema.names
        if name != "churn_events":
            assert sorted(map(repr, rows(tables[name]))) == sorted(map(repr, rows(good[name])))
    events = tables["churn_events"]
    assert events.filter("churn_event_id = 'ev-x'").isEmpty()
    assert events.select("reason_code").count() == events.count()
    found = rejected_rows(spark, str(tmp_path / "rejected")).collect()
    assert {r.table for r in found} == {"churn_events"} and bad in {r.line for r in found} and len(found) == 2
    counts = rejected_counts(spark, str(tmp_path / "rejected")).collect()
    assert [(r.table, r.rejected, r.file.endswith("churn_events.csv")) for r in counts] == [("churn_events", 2, True)]
