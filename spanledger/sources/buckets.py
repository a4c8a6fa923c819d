"""Usage and records stored by subscription, so that joins between them move neither."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: About 128 MB of some 30 TB of usage columns each; a number for smaller tables is a parameter.
BUCKETS = 65_536


def bucketed(df: DataFrame, table: str, key: str = "subscription_id", buckets: int = BUCKETS) -> DataFrame:
    """``df`` as a catalog table in buckets of ``key``, sorted within, and read back.

    Rows of a key meet in one bucket, so the writing shuffle is the only one: tables of the
    same key and number of buckets are joined where they lie.  A task of the writing job
    holds one bucket, so each bucket is one file.
    """
    (
        df.repartition(buckets, key)
        .sortWithinPartitions(key)
        .write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def by_record(
    usage: DataFrame, subscriptions: DataFrame, name: str, buckets: int = BUCKETS
) -> tuple[DataFrame, DataFrame]:
    """Usage and records as the tables ``<name>_usage`` and ``<name>_records``.

    With these ``usage_with_account`` and all that joins usage (``eng_*``,
    ``dq11_usage_in_window``) reads usage without an exchange, however often it runs.
    """
    return bucketed(usage, f"{name}_usage", buckets=buckets), bucketed(subscriptions, f"{name}_records", buckets=buckets)
