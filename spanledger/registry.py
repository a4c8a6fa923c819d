"""Every operator bound to the order-star tables, under its name."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from spanledger.operators import acquisition as acq
from spanledger.operators import churn as ch
from spanledger.operators import conversion as conv
from spanledger.operators import engagement as eng
from spanledger.operators import quality as dq
from spanledger.operators import retention as ret
from spanledger.operators import revenue as rev
from spanledger.operators import summary as summ
from spanledger.operators import support as sup
from spanledger.operators import value as val
from spanledger.plans import spine as sp
from spanledger.plans.relations import account_cohorts, churn_status, cohort_sizes, usage_with_account
from spanledger.sources import orders_star as star
from spanledger.sources.raw import load_row_counts

class Inputs:
    """The five lifecycle tables, and what several operators take besides them.

    ``expected`` has the rows each table should have, and ``churned_accounts``;
    without it every table is expected to be empty.
    """

    def __init__(
        self, tables: Mapping[str, DataFrame], expected: Mapping[str, int | Column] | None = None
    ) -> None:
        self.expected = expected or dict.fromkeys([*tables, "churned_accounts"], 0)
        self.accounts = tables["accounts"]
        self.subscriptions = tables["subscriptions"]
        self.usage = tables["feature_usage"]
        self.tickets = tables["support_tickets"]
        self.churn = tables["churn_events"]

    @property
    def profiles(self) -> DataFrame:
        """Accounts, for operators that use neither the signup date nor the country."""
        return self.accounts

    @property
    def located(self) -> DataFrame:
        """Accounts, for operators that use the country but not the signup date."""
        return self.accounts

    @cached_property
    def spine(self) -> DataFrame:
        return sp.calendar_month_spine(self.accounts, self.subscriptions, self.usage, self.churn)

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {
            "accounts": self.profiles,
            "subscriptions": self.subscriptions,
            "feature_usage": self.usage,
            "support_tickets": self.tickets,
            "churn_events": self.churn,
        }

    def marts(self) -> dict[str, DataFrame]:
        return {
            "acq_monthly": acq.acq_monthly(self.accounts, sp.signup_months(self.accounts)),
            "churn_repeat_summary": ch.churn_repeat_summary(self.churn),
            "conv_subscription_overall": conv.conv_subscription_overall(self.subscriptions),
            "mrr_monthly": rev.mrr_monthly(self.subscriptions),
            "ret_pooled_curve": ret.ret_pooled_curve(self.accounts, self.subscriptions, 6),
        }


class StarInputs(Inputs):
    """The tables derived from the order tables, each planned only when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @cached_property
    def accounts(self) -> DataFrame:
        return star.accounts(self.spark, self.folder, country=False)

    @cached_property
    def profiles(self) -> DataFrame:
        """Without the signup date, which alone needs a scan of the orders."""
        return star.accounts(self.spark, self.folder, signup=False, country=False)

    @cached_property
    def located(self) -> DataFrame:
        return star.accounts(self.spark, self.folder, signup=False)

    @cached_property
    def expected(self) -> dict[str, Column]:
        return star.expected_counts(self.spark, self.folder)

    @cached_property
    def subscriptions(self) -> DataFrame:
        return star.subscriptions(self.spark, self.folder)

    @cached_property
    def usage(self) -> DataFrame:
        return star.feature_usage(self.spark, self.folder)

    @cached_property
    def tickets(self) -> DataFrame:
        return star.support_tickets(self.spark, self.folder)

    @cached_property
    def churn(self) -> DataFrame:
        return star.churn_events(self.spark, self.folder)


def _signup_spine(i: Inputs) -> DataFrame:
    return sp.calendar_month_spine(i.accounts, i.subscriptions)


def _open_months(i: Inputs) -> DataFrame:
    return sp.open_month_records(i.subscriptions, i.spine).select(
        "subscription_id", "account_id", "month_start", "mrr_amount"
    )


def _headline_check(i: Inputs) -> DataFrame:
    return summ.summary_reconcile(
        i.profiles,
        i.churn,
        *[i.expected[name] for name in ("accounts", "churn_events", "churned_accounts")],
    )


def _row_counts(i: Inputs) -> DataFrame:
    return dq.dq01_row_counts(i.tables, {name: i.expected[name] for name in i.tables})


OPERATORS: dict[str, Callable[[Inputs], DataFrame]] = {
    "load_row_counts": lambda i: load_row_counts(i.tables),
    "calendar_month_spine": lambda i: i.spine,
    "spine_validate": lambda i: sp.spine_validate(i.spine),
    "open_month_records": _open_months,
    "churn_status": lambda i: churn_status(i.profiles.select("account_id", "plan_tier"), i.churn),
    "usage_with_account": lambda i: usage_with_account(i.usage, i.subscriptions),
    "account_cohorts": lambda i: account_cohorts(i.accounts),
    "cohort_sizes": lambda i: cohort_sizes(i.accounts),
    "dq01_row_counts": _row_counts,
    "dq02_key_uniqueness": lambda i: dq.dq02_key_uniqueness(i.tables),
    "dq03_duplicate_keys": lambda i: dq.dq03_duplicate_keys(i.usage),
    "dq03_duplicate_summary": lambda i: dq.dq03_duplicate_summary(i.usage),
    "dq04_fk_orphans": lambda i: dq.dq04_fk_orphans(i.tables),
    "dq05_open_sub_histogram": lambda i: dq.dq05_open_sub_histogram(i.subscriptions),
    "dq05_open_sub_summary": lambda i: dq.dq05_open_sub_summary(i.subscriptions),
    "dq06_open_rate": lambda i: dq.dq06_open_rate(i.subscriptions),
    "dq07_derived_column": lambda i: dq.dq07_derived_column(i.subscriptions),
    "dq08_trial_vs_zero_mrr": lambda i: dq.dq08_trial_vs_zero_mrr(i.subscriptions),
    "dq08_churn_flag_vs_end": lambda i: dq.dq08_churn_flag_vs_end(i.subscriptions),
    "dq09_flag_vs_events": lambda i: dq.dq09_flag_vs_events(i.profiles, i.churn),
    "dq10_events_per_account": lambda i: dq.dq10_events_per_account(i.churn),
    "dq11_usage_in_window": lambda i: dq.dq11_usage_in_window(i.usage, i.subscriptions),
    "dq12_score_missingness": lambda i: dq.dq12_score_missingness(i.tickets),
    "dq13_feedback_missingness": lambda i: dq.dq13_feedback_missingness(i.churn),
    "dq14_impossible_dates": lambda i: dq.dq14_impossible_dates(
        i.accounts, i.subscriptions, i.tickets, i.churn
    ),
    "dq15_category_inventory": lambda i: dq.dq15_category_inventory(i.tables),
    "dq16_signup_gap_buckets": lambda i: dq.dq16_signup_gap_buckets(i.accounts, i.subscriptions),
    "acq_monthly": lambda i: acq.acq_monthly(i.accounts, _signup_spine(i)),
    "acq_by_referral": lambda i: acq.acq_by_referral(i.profiles),
    "acq_by_plan": lambda i: acq.acq_by_plan(i.profiles),
    "acq_by_industry": lambda i: acq.acq_by_industry(i.profiles),
    "acq_by_country": lambda i: acq.acq_by_country(i.located),
    "acq_referral_by_plan": lambda i: acq.acq_referral_by_plan(i.profiles),
    "acq_reconcile": lambda i: acq.acq_reconcile(i.accounts, _signup_spine(i)),
    "acq_rolling_mean": lambda i: acq.acq_rolling_mean(
        acq.acq_monthly(i.accounts, _signup_spine(i))
    ),
    "mrr_monthly": lambda i: rev.mrr_monthly(i.subscriptions),
    "mrr_by_plan": lambda i: rev.mrr_by_plan(i.subscriptions),
    "mrr_trial_paid": lambda i: rev.mrr_trial_paid(i.subscriptions),
    "mrr_reconcile": lambda i: rev.mrr_reconcile(i.subscriptions),
    "conv_subscription_overall": lambda i: conv.conv_subscription_overall(i.subscriptions),
    "conv_subscription_by_plan": lambda i: conv.conv_subscription_by_plan(i.subscriptions),
    "conv_account_overall": lambda i: conv.conv_account_overall(i.subscriptions),
    "conv_account_by_cohort": lambda i: conv.conv_account_by_cohort(i.accounts, i.subscriptions),
    "conv_reconcile": lambda i: conv.conv_reconcile(i.subscriptions),
    "ret_matrix": lambda i: ret.ret_matrix(i.accounts, i.subscriptions, i.spine),
    "ret_pooled_curve": lambda i: ret.ret_pooled_curve(i.accounts, i.subscriptions),
    "ret_month_m_check": lambda i: ret.ret_month_m_check(i.accounts, i.subscriptions),
    "ret_ever_active": lambda i: ret.ret_ever_active(i.profiles, i.subscriptions),
    "ret_active_in_signup_month": lambda i: ret.ret_active_in_signup_month(
        i.accounts, i.subscriptions
    ),
    "value_by_cohort": lambda i: val.value_by_cohort(i.accounts, i.subscriptions, i.spine),
    "value_first_6_months": lambda i: val.value_first_6_months(i.accounts, i.subscriptions),
    "value_reconcile": lambda i: val.value_reconcile(i.accounts, i.subscriptions, i.spine),
    "eng_top_features": lambda i: eng.eng_top_features(i.usage, i.subscriptions),
    "eng_feature_errors": lambda i: eng.eng_feature_errors(i.usage, i.subscriptions),
    "eng_beta_vs_ga": lambda i: eng.eng_beta_vs_ga(i.usage),
    "eng_feature_by_churn": lambda i: eng.eng_feature_by_churn(i.usage, i.subscriptions, i.churn),
    "eng_summary_by_churn": lambda i: eng.eng_summary_by_churn(i.usage, i.subscriptions, i.churn),
    "eng_reconcile": lambda i: eng.eng_reconcile(i.usage, i.subscriptions),
    "eng_top_n": lambda i: eng.eng_top_n(eng.eng_top_features(i.usage, i.subscriptions)),
    "eng_churn_gap": lambda i: eng.eng_churn_gap(
        eng.eng_summary_by_churn(i.usage, i.subscriptions, i.churn)
    ),
    "churn_monthly": lambda i: ch.churn_monthly(
        i.churn, sp.calendar_month_spine(i.accounts, i.subscriptions, churn=i.churn)
    ),
    "churn_by_reason": lambda i: ch.churn_by_reason(i.churn),
    "churn_by_plan": lambda i: ch.churn_by_plan(i.churn, i.profiles),
    "churn_time_to_first": lambda i: ch.churn_time_to_first(i.churn, i.accounts),
    "churn_time_to_first_summary": lambda i: ch.churn_time_to_first_summary(i.churn, i.accounts),
    "churn_repeat_histogram": lambda i: ch.churn_repeat_histogram(i.churn),
    "churn_repeat_summary": lambda i: ch.churn_repeat_summary(i.churn),
    "churn_refund_by_reason": lambda i: ch.churn_refund_by_reason(i.churn),
    "churn_refund_total": lambda i: ch.churn_refund_total(i.churn),
    "churn_preceding_flags": lambda i: ch.churn_preceding_flags(i.churn),
    "churn_reconcile": lambda i: ch.churn_reconcile(i.churn),
    "sup_volume_by_churn": lambda i: sup.sup_volume_by_churn(i.tickets, i.churn),
    "sup_priority_mix": lambda i: sup.sup_priority_mix(i.tickets, i.churn),
    "sup_resolution_by_priority": lambda i: sup.sup_resolution_by_priority(i.tickets, i.churn),
    "sup_satisfaction": lambda i: sup.sup_satisfaction(i.tickets, i.churn),
    "sup_reconcile": lambda i: sup.sup_reconcile(i.tickets, i.churn),
    "business_summary": lambda i: summ.business_summary(
        i.accounts, i.subscriptions, i.usage, i.tickets, i.churn
    ),
    "summary_reconcile": _headline_check,
    "overview_headline": lambda i: summ.overview_headline(i.marts()),
}


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Decimal columns as DOUBLE, the type in which results are compared across engines."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else f.name
            for f in df.schema.fields
        ]
    )


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return decimals_as_double(OPERATORS[name](StarInputs(spark, folder)))

    return run
