"""The result set as files: compute every mart, write it, and reconcile the totals."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spanledger.operators import acquisition, churn, conversion, engagement, retention, revenue, support
from spanledger.operators.quality import dq02_key_uniqueness
from spanledger.plans.observed import seen
from spanledger.plans.spine import calendar_month_spine
from spanledger.sources.files import exists, remove
from spanledger.sources.marts import MART_PATHS, publish, write_mart


def shared_folder(spark: SparkSession, work: str | None = None) -> str:
    """A new folder for intermediate tables under ``work``, else the cluster's checkpoint folder."""
    root = work or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir or name a folder that all executors share")
    return f"{root.rstrip('/')}/spanledger-{uuid.uuid4().hex}"


def check_keys(tables: Mapping[str, DataFrame]) -> None:
    """Raise when a declared key repeats or is missing; counts of records rest on them."""
    bad = dq02_key_uniqueness(tables).filter("total_rows <> distinct_values").collect()
    if bad:
        found = ", ".join(f"{r.key_column}: {r.distinct_values} values in {r.total_rows} rows" for r in bad)
        raise ValueError(f"declared keys are not unique ({found})")


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as a table and read back, so its readers do not depend on its lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mart_frames(
    tables: Mapping[str, DataFrame],
    spine: DataFrame,
    by_feature_account: DataFrame,
    groupings: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every mart, lazily, under its operator name.

    ``groupings`` are the accounts counted by each of their categories at once
    (``acq_groupings``), from which four marts follow without a scan of their own.
    """
    accounts, subscriptions = tables["accounts"], tables["subscriptions"]
    tickets, events = tables["support_tickets"], tables["churn_events"]
    by_account = by_feature_account.groupBy("account_id").agg(
        *[F.sum(c).alias(c) for c in ("events", "uses", "secs", "errors")]
    )
    return {
        "acq_monthly": acquisition.acq_monthly(accounts, spine),
        "acq_by_referral": acquisition.acq_by_referral(accounts, groupings),
        "acq_by_plan": acquisition.acq_by_plan(accounts, groupings),
        "acq_by_industry": acquisition.acq_by_industry(accounts, groupings),
        "acq_by_country": acquisition.acq_by_country(accounts, groupings),
        "mrr_monthly": revenue.mrr_monthly(subscriptions, spine),
        "mrr_by_plan": revenue.mrr_by_plan(subscriptions, spine),
        "conv_subscription_overall": conversion.conv_subscription_overall(subscriptions),
        "conv_subscription_by_plan": conversion.conv_subscription_by_plan(subscriptions),
        "conv_account_overall": conversion.conv_account_overall(subscriptions),
        "ret_pooled_curve": retention.ret_pooled_curve(accounts, subscriptions),
        "eng_top_features": engagement.top_features(by_feature_account),
        "eng_summary_by_churn": engagement.summary_by_churn(by_account, events),
        "churn_monthly": churn.churn_monthly(events, spine),
        "churn_by_reason": churn.churn_by_reason(events),
        "churn_by_plan": churn.churn_by_plan(events, accounts),
        "churn_repeat_summary": churn.churn_repeat_summary(events),
        "sup_volume_by_churn": support.sup_volume_by_churn(tickets, events),
        "sup_priority_mix": support.sup_priority_mix(tickets, events),
    }


#: Marts that must add up to the rows of a table, and the measure that does.
ADDS_UP = {"acq_monthly": ("new_accounts", "accounts"), "churn_monthly": ("churn_events", "churn_events")}


def build_marts(
    tables: Mapping[str, DataFrame], out: str, fmt: str = "csv", work: str | None = None
) -> dict[str, str]:
    """Write every mart under ``out`` and return their paths.

    The five tables are parsed once and staged as Parquet in the shared folder
    (``work``, else spark.checkpoint.dir), and so are the spine and the usage
    totals, which serve several marts; the folder is removed when the build ends.

    The marts are written to a folder of their own under ``out``, compared with
    their tables, and only then put in the place of the marts of an earlier build,
    which stay as they are when anything fails before.  Raises when a declared key
    repeats and when a written mart does not add up to its table.
    """
    spark = tables["accounts"].sparkSession
    folder, out = shared_folder(spark, work), out.rstrip("/")
    built = f"{out}/_building-{uuid.uuid4().hex}"
    fresh = not exists(spark, out)
    done = False
    try:
        rows = {name: Observation() for name in tables}
        staged = {
            name: _written(df.observe(rows[name], F.count(F.lit(1)).alias("rows")), f"{folder}/{name}")
            for name, df in tables.items()
        }
        check_keys(staged)
        totals = _build(spark, staged, built, fmt, folder)
        for name, (measure, table) in ADDS_UP.items():
            if totals[name] != (found := seen(rows[table], "rows", 0)):
                raise ValueError(f"{name}: {measure} adds up to {totals[name]}, the table has {found} rows")
        publish(spark, built, out, MART_PATHS.values())
        done = True
        return {name: f"{out}/{stem}" for name, stem in MART_PATHS.items()}
    finally:
        remove(spark, folder)
        remove(spark, built if done or not fresh else out)


def _build(
    spark: SparkSession, tables: Mapping[str, DataFrame], built: str, fmt: str, work: str
) -> dict[str, int]:
    """Write every mart under ``built``; the totals of ADDS_UP are taken from the rows as they are written."""
    accounts, events = tables["accounts"], tables["churn_events"]
    spine = _written(
        calendar_month_spine(
            accounts, tables["subscriptions"], tables["feature_usage"], events
        ),
        f"{work}/spine",
    )
    by_feature_account = _written(
        engagement.usage_by_feature_account(tables["feature_usage"], tables["subscriptions"]),
        f"{work}/usage_by_feature_account",
    )
    groupings = _written(acquisition.acq_groupings(accounts), f"{work}/groupings")
    totals = {name: Observation() for name in ADDS_UP}
    for name, frame in mart_frames(tables, spine, by_feature_account, groupings).items():
        if name in totals:
            total = F.coalesce(F.sum(ADDS_UP[name][0]), F.lit(0)).alias("total")
            frame = frame.observe(totals[name], total)
        write_mart(frame, f"{built}/{MART_PATHS[name]}", fmt)
    return {name: seen(total, "total", 0) for name, total in totals.items()}
