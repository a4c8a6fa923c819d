"""Monthly totals that a later batch adds to, so that history is not read again.

What a batch of records changes per month (``plans.steps``) adds up over batches, and
so do signups per month.  Each batch is stored as a few rows a month in a folder of
its own name; writing a batch again replaces it.  Distinct churned accounts do not add
up, so of churn events each (month, account) is stored with its events, and counted
over all batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions.months import month_number, month_start
from spanledger.operators.revenue import mrr_by_plan_of, mrr_monthly_of, plan_steps
from spanledger.schema import PLAN_TIERS
from spanledger.sources.files import exists

STEPS, SIGNUPS, CHURN = "steps", "signups", "churn"


class StepLedger:
    """The stored steps under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, tiers: tuple[str, ...] = PLAN_TIERS):
        self.spark, self.folder, self.tiers = spark, folder.rstrip("/"), tiers

    def append(
        self,
        batch: str,
        subscriptions: DataFrame | None = None,
        replaced: DataFrame | None = None,
        accounts: DataFrame | None = None,
        churn: DataFrame | None = None,
    ) -> None:
        """Store what a batch adds.

        ``subscriptions`` are new records and new versions of known ones (an end date, say);
        ``replaced`` the versions they stand for, whose steps are taken back.  ``accounts`` and
        ``churn`` are new rows.  Only the batch is read.
        """
        if subscriptions is not None or replaced is not None:
            parts = []
            for records, sign in ((subscriptions, 1), (replaced, -1)):
                if records is not None:
                    steps = plan_steps(records, self.tiers)
                    amounts = [c for c in steps.columns if c != "month_no"]
                    parts.append(steps.select("month_no", *[(F.col(c) * sign).alias(c) for c in amounts]))
            self._write(STEPS, batch, _added_up(reduce(DataFrame.unionByName, parts), ["month_no"]))
        if accounts is not None:
            months = accounts.groupBy(month_number(F.col("signup_date")).alias("month_no"))
            self._write(SIGNUPS, batch, months.agg(F.count("account_id").alias("accounts")))
        if churn is not None:
            months = churn.groupBy(month_number(F.col("churn_date")).alias("month_no"), "account_id")
            self._write(CHURN, batch, months.agg(F.count("churn_event_id").alias("events")))

    def _write(self, name: str, batch: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def _read(self, name: str) -> DataFrame:
        if not exists(self.spark, f"{self.folder}/{name}"):
            raise ValueError(f"no batch with {name} under {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{name}").drop("batch")

    def steps(self) -> DataFrame:
        """One row per month with a change, over all batches."""
        return _added_up(self._read(STEPS), ["month_no"])

    def mrr_monthly(self, spine: DataFrame | None = None) -> DataFrame:
        """As ``revenue.mrr_monthly`` over all records."""
        return mrr_monthly_of(self.steps(), spine)

    def mrr_by_plan(self, spine: DataFrame | None = None) -> DataFrame:
        """As ``revenue.mrr_by_plan`` over all records."""
        return mrr_by_plan_of(self.steps(), spine, self.tiers)

    def acq_monthly(self, spine: DataFrame) -> DataFrame:
        """As ``acquisition.acq_monthly`` over all accounts."""
        signups = _added_up(self._read(SIGNUPS), ["month_no"])
        return _over_spine(signups, spine, {"accounts": "new_accounts"})

    def churn_monthly(self, spine: DataFrame) -> DataFrame:
        """As ``churn.churn_monthly`` over all events."""
        months = self._read(CHURN).groupBy("month_no").agg(
            F.sum("events").alias("events"), F.countDistinct("account_id").alias("accounts")
        )
        return _over_spine(months, spine, {"events": "churn_events", "accounts": "unique_churned_accounts"})


def _added_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


def _over_spine(months: DataFrame, spine: DataFrame, names: dict[str, str]) -> DataFrame:
    """Spine months to the last of ``months``; what a month lacks is 0."""
    last = months.agg(month_start(F.max("month_no"))).scalar()
    dated = months.withColumn("month_start", month_start(F.col("month_no")))
    return (
        spine.filter(F.col("month_start") <= last)
        .join(dated, "month_start", "left")
        .select(
            "month_label", "month_start", *[F.coalesce(c, F.lit(0)).alias(name) for c, name in names.items()]
        )
        .orderBy("month_start")
    )
