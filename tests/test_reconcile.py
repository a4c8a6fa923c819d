"""Totals along different paths agree, and hand-computed values on the edge cases."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from star import STAR

from spanledger.operators import churn, conversion, engagement, retention, revenue, value
from spanledger.plans.relations import account_cohorts, churn_status, usage_with_account
from spanledger.plans.spine import calendar_month_spine, open_month_records
from spanledger.registry import OPERATORS, Inputs, StarInputs, query


@pytest.fixture(scope="module")
def star(spark):
    return StarInputs(spark, STAR)


def one(df):
    return df.first().asDict()


def test_acquisition_paths_agree(spark):
    row = one(query("acq_reconcile")(spark, STAR))
    assert len(set(row.values())) == 1


def test_churn_paths_agree(spark, star):
    row = one(churn.churn_reconcile(star.churn))
    monthly = query("churn_monthly")(spark, STAR).agg(F.sum("churn_events")).first()[0]
    assert row["total_churn_events"] == row["total_via_reason_code_sum"] == monthly


def test_plan_revenue_sums_to_the_total_in_every_month(star):
    tiers = revenue.mrr_by_plan(star.subscriptions)
    parts = sum(F.coalesce(f"{t}_mrr", F.lit(0)) for t in ("basic", "pro", "enterprise"))
    assert tiers.filter(parts != F.col("total_mrr")).count() == 0
    both = tiers.join(revenue.mrr_monthly(star.subscriptions), "month_start")
    assert both.count() == tiers.count()
    assert both.filter("total_mrr <> aggregate_subscription_mrr").count() == 0


def test_a_spine_changes_nothing_but_the_months_it_leaves_out(star):
    free = revenue.mrr_monthly(star.subscriptions)
    spined = revenue.mrr_monthly(star.subscriptions, star.spine)
    assert free.collect() == spined.collect()
    some = star.spine.filter("month_start >= '1997-03-01' AND month(month_start) <> 5")
    kept = free.filter("month_start >= '1997-03-01' AND month(month_start) <> 5")
    assert revenue.mrr_monthly(star.subscriptions, some).collect() == kept.collect()


def test_latest_month_agrees_with_the_direct_sum(star):
    latest = revenue.mrr_monthly(star.subscriptions).orderBy(F.desc("month_start")).first()
    direct = one(revenue.mrr_reconcile(star.subscriptions))
    assert latest.aggregate_subscription_mrr == direct["latest_month_mrr_direct_calc"]


def test_steps_agree_with_the_row_level_relation(star):
    rows = (
        open_month_records(star.subscriptions, star.spine)
        .groupBy("month_start")
        .agg(F.countDistinct("subscription_id").alias("n"), F.sum("mrr_amount").alias("mrr"))
    )
    monthly = revenue.mrr_monthly(star.subscriptions)
    both = monthly.join(rows, "month_start")
    assert both.count() == monthly.count()
    assert both.filter("n <> active_subscription_records OR mrr <> aggregate_subscription_mrr").count() == 0


def test_row_level_relation_agrees_with_the_overlap_join(edge):
    subs, spine = edge[0].subscriptions, edge[0].spine
    overlap = spine.join(
        subs,
        (F.col("start_date") <= F.col("month_end"))
        & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("month_start"))),
    )
    keys = ["subscription_id", "month_start"]
    ours = open_month_records(subs, spine).select(*keys)
    assert sorted(ours.collect()) == sorted(overlap.select(*keys).collect())


def test_month_six_agrees_along_both_paths(star):
    curve = retention.ret_pooled_curve(star.accounts, star.subscriptions)
    at_six = one(curve.filter("months_since_signup = 6").drop("months_since_signup"))
    assert list(at_six.values()) == list(
        one(retention.ret_month_m_check(star.accounts, star.subscriptions)).values()
    )


def test_every_month_agrees_along_both_paths(edge):
    inputs, _ = edge
    curve = retention.ret_pooled_curve(inputs.accounts, inputs.subscriptions).collect()
    for row in curve[::3]:
        check = retention.ret_month_m_check(
            inputs.accounts, inputs.subscriptions, row.months_since_signup
        )
        assert list(row[1:]) == list(check.first())


def test_eligible_accounts_are_the_signups_old_enough(star):
    curve = retention.ret_pooled_curve(star.accounts, star.subscriptions).collect()
    last = star.subscriptions.agg(F.max(F.trunc("start_date", "MM"))).first()[0]
    for row in curve[::6]:
        old = account_cohorts(star.accounts).filter(
            F.add_months("cohort_month", row.months_since_signup) <= F.lit(last)
        )
        assert row.eligible_accounts == old.count()


def test_matrix_without_buffer_sums_to_the_curve(star):
    matrix = retention.ret_matrix(
        star.accounts, star.subscriptions, star.spine, cap_to_observed=True
    )
    per_m = matrix.groupBy("months_since_signup").agg(F.sum("active_accounts").alias("n"))
    curve = retention.ret_pooled_curve(star.accounts, star.subscriptions)
    assert per_m.join(curve, "months_since_signup").filter("n <> active_accounts").count() == 0


def test_first_six_months_are_the_sixth_running_total(star):
    by_month = value.value_by_cohort(star.accounts, star.subscriptions, star.spine)
    upto = (
        by_month.filter("months_since_signup < 6")
        .groupBy("cohort_month")
        .agg(F.max("cumulative_observed_mrr").alias("running"))
    )
    first = value.value_first_6_months(star.accounts, star.subscriptions)
    both = first.join(upto, "cohort_month", "left")
    wrong = both.filter("NOT observed_mrr_first_6_months <=> running")
    assert both.count() > 10 and wrong.count() == 0


def test_value_paths_agree_where_every_record_has_its_account(star):
    rows = value.value_reconcile(star.accounts, star.subscriptions, star.spine).collect()
    months = revenue.mrr_monthly(star.subscriptions, star.spine).count()
    assert len(rows) >= months > 24 and all(r.reconciles for r in rows)
    first = value.value_reconcile(star.accounts, star.subscriptions, star.spine, months=24).collect()
    assert first == rows[:24]


def _overlap(subscriptions, spine):
    """Records and months by the overlap join itself."""
    return spine.join(
        subscriptions,
        (F.col("start_date") <= F.col("month_end"))
        & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("month_start"))),
    )


@pytest.mark.parametrize(
    "months",
    [
        "month_start >= '1996-01-01'",
        "month_start >= '1996-01-01' AND month(month_start) NOT IN (5, 6) AND month_start < '1998-01-01'",
        "month_start = '1997-03-01'",
        "false",
    ],
)
def test_only_months_of_the_spine_count(star, months):
    spine = star.spine.filter(months)
    overlap = _overlap(star.subscriptions, spine)
    keys = ["subscription_id", "month_start"]
    ours = open_month_records(star.subscriptions, spine).select(*keys)
    assert sorted(ours.collect()) == sorted(overlap.select(*keys).collect())

    since = F.months_between("month_start", "cohort_month").cast("int")
    cells = (
        overlap.join(account_cohorts(star.accounts), "account_id")
        .filter("month_start >= cohort_month")
        .groupBy(F.date_format("cohort_month", "yyyy-MM").alias("cohort"), since.alias("m"))
        .agg(
            F.countDistinct("account_id").alias("accounts"),
            F.countDistinct("subscription_id").alias("records"),
            F.sum("mrr_amount").alias("mrr"),
        )
    )
    for max_m in (18, None):
        want = sorted(cells.filter("true" if max_m is None else f"m <= {max_m}").collect())
        matrix = retention.ret_matrix(star.accounts, star.subscriptions, spine, max_m)
        got = matrix.select("cohort_month", "months_since_signup", "active_accounts").collect()
        assert sorted(map(tuple, got)) == [(r.cohort, r.m, r.accounts) for r in want]
        by_cohort = value.value_by_cohort(star.accounts, star.subscriptions, spine, max_m)
        got = by_cohort.select(
            "cohort_month", "months_since_signup", "open_subscription_records", "observed_subscription_mrr"
        ).collect()
        assert sorted(map(tuple, got)) == [(r.cohort, r.m, r.records, r.mrr) for r in want]


def test_the_whole_history_extends_the_default_one(star):
    short = retention.ret_pooled_curve(star.accounts, star.subscriptions).collect()
    whole = retention.ret_pooled_curve(star.accounts, star.subscriptions, max_m=None).collect()
    assert len(short) == 19 and len(whole) > 19 and whole[:19] == short


def test_expectations_that_hold_and_that_do_not(spark, edge):
    assert all(r.actual_rows == r.expected_rows > 0 for r in query("dq01_row_counts")(spark, STAR).collect())
    assert set(one(query("summary_reconcile")(spark, STAR)).values()) == {True}
    tables = edge[0].tables
    right = {name: df.count() for name, df in tables.items()}
    right["churned_accounts"] = tables["churn_events"].select("account_id").distinct().count()
    counts = OPERATORS["dq01_row_counts"](Inputs(tables, right)).collect()
    assert all(r.actual_rows == r.expected_rows for r in counts)
    for wrong in ("accounts", "churn_events", "churned_accounts"):
        row = one(OPERATORS["summary_reconcile"](Inputs(tables, right | {wrong: right[wrong] + 1})))
        assert list(row.values()).count(False) == 1
    assert set(one(OPERATORS["summary_reconcile"](Inputs(tables, right))).values()) == {True}


def test_value_paths_differ_by_the_records_without_account(edge):
    inputs, _ = edge
    rows = value.value_reconcile(inputs.accounts, inputs.subscriptions, inputs.spine).collect()
    assert {r.month for r in rows if not r.reconciles} == {"2023-03", "2023-04"}


def test_feature_events_sum_to_the_joined_rows(star):
    total = engagement.eng_top_features(star.usage, star.subscriptions).agg(F.sum("usage_events"))
    joined = usage_with_account(star.usage, star.subscriptions).count()
    assert total.first()[0] == joined == one(engagement.eng_reconcile(star.usage, star.subscriptions))[
        "total_usage_events_after_join"
    ]


def test_conversion_agrees_with_a_row_wise_search(star):
    trials = star.subscriptions.filter("is_trial").alias("t")
    paid = star.subscriptions.filter("NOT is_trial").alias("p")
    later = trials.join(
        paid, F.expr("t.account_id = p.account_id AND p.start_date >= t.start_date"), "left_semi"
    )
    row = one(conversion.conv_subscription_overall(star.subscriptions))
    assert row["total_trial_subscription_records"] == trials.count()
    assert row["trial_records_with_later_paid_record"] == later.count()


def test_churn_status_keeps_every_row_once(edge):
    inputs, _ = edge
    marked = churn_status(inputs.accounts.select("account_id"), inputs.churn)
    got = {r.account_id: r.is_churned_account for r in marked.collect()}
    assert {k for k, churned in got.items() if churned} == {
        "edges", "many", "late_trial", "same_day_trial"
    }
    assert marked.count() == inputs.accounts.count()


def test_conversion_on_hand(edge):
    row = one(conversion.conv_subscription_overall(edge[0].subscriptions))
    # Converted: the same-day trial, and neither an only-trials nor a late trial;
    # s19 of "many" has no paid record on or after 2023-06-16 (s18 is one day earlier).
    assert row == {
        "total_trial_subscription_records": 5,
        "trial_records_with_later_paid_record": 1,
        "subscription_level_conversion_rate_pct": 20.0,
    }
    cohorts = conversion.conv_account_by_cohort(edge[0].accounts, edge[0].subscriptions)
    by_month = {r.cohort_month: r for r in cohorts.collect()}
    assert by_month["2023-09"].accounts_with_any_trial == 0
    assert by_month["2023-09"].conversion_rate_pct is None


def test_revenue_on_hand(edge):
    rows = {r.month_start: r for r in revenue.mrr_by_plan(edge[0].subscriptions).collect()}
    january = rows[date(2024, 1, 1)]
    assert january.pro_mrr == Decimal("10.00")  # open and closed on one day
    assert rows[date(2023, 2, 1)].pro_mrr is None  # no open record of that plan
    assert rows[date(2023, 5, 1)].pro_mrr == Decimal("7.77")  # ends before it starts, same month
    assert rows[date(2023, 10, 1)].enterprise_mrr == Decimal("49.01")  # ends on the first of a month


def test_months_without_any_open_record_are_absent(spark, edge):
    subs = edge[0].subscriptions.filter("subscription_id IN ('s02', 's03')")
    months = [r.month_start for r in revenue.mrr_monthly(subs).collect()]
    assert months == [date(2023, 3, 1), date(2024, 1, 1)]


def test_spine_is_gap_free_and_reaches_three_months_beyond(edge):
    inputs, _ = edge
    months = [r.month_start for r in inputs.spine.orderBy("month_start").collect()]
    assert months[0] == date(2022, 11, 1) and months[-1] == date(2024, 12, 1)
    assert len(months) == 26
    short = calendar_month_spine(inputs.accounts, inputs.subscriptions, buffer_months=0)
    assert short.agg(F.max("month_start")).first()[0] == date(2024, 6, 1)
