"""Account stretches stored once, for the operators that follow accounts over time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanledger.functions.measures import hundredths
from spanledger.functions.months import month_number
from spanledger.plans.observed import seen
from spanledger.plans.spine import last_start_month
from spanledger.plans.steps import account_segments


@dataclass(frozen=True)
class History:
    """Stretches of months per account over which its open records do not change.

    ``segments``: account_id, seg_from, seg_to, open_records and ``mrr`` in hundredths;
    ``last_start``: the month number of the latest record start, None without any.
    """

    segments: DataFrame
    last_start: int | None


def store_history(subscriptions: DataFrame, path: str) -> History:
    """Write the stretches under ``path``: one scan of the records serves every reader.

    The latest start is observed in the same scan.
    """
    watch = Observation()
    watched = subscriptions.observe(watch, F.max(month_number(F.col("start_date"))).alias("last_start"))
    segments = account_segments(watched, {"mrr": hundredths(subscriptions, "mrr_amount")})
    segments.write.mode("overwrite").parquet(path)
    stored = subscriptions.sparkSession.read.schema(segments.schema).parquet(path)
    return History(stored, seen(watch, "last_start", None))


def segments_of(source: DataFrame | History, with_mrr: bool) -> DataFrame:
    """Stretches of records, or those stored."""
    if isinstance(source, History):
        return source.segments if with_mrr else source.segments.drop("mrr")
    return account_segments(source, {"mrr": hundredths(source, "mrr_amount")} if with_mrr else {})


def last_start_of(source: DataFrame | History) -> Column:
    """Month number of the latest record start."""
    if isinstance(source, History):
        return F.lit(source.last_start).cast("int")
    return last_start_month(source)
