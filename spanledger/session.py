"""Session settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Scans read few columns, so a larger split still makes a small task; small
    # inputs are split by the number of cores all the same.
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.session.timeZone": "UTC",
    # Recording the Python line of every column costs several driver calls each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Shuffle partitions for about 100 TB of tables, by what a job shuffles at most.  A
# shuffle starts from this many and is coalesced to the advisory size, never split
# beyond them; every map task keeps account of each, so a job that shuffles a few
# rows a month wants few.
#   months: monthly revenue, plain checks, shares by a category
#   accounts: retention, cohort value, conversion, churn, support, the summary
#   usage: engagement by feature, usage in window, duplicate keys, marts
PARTITIONS = {"months": 64, "accounts": 4_096, "usage": 65_536}


def partitions_for(shuffled_bytes: int, size: int = 128 << 20) -> int:
    """Partitions of about ``size`` for a job whose largest shuffle is known."""
    return max(8, -(-shuffled_bytes // size))


def session(
    name: str = "spanledger", shuffle_partitions: int | str = "accounts", **extra: str
) -> SparkSession:
    """A session with these settings; master and resources come from spark-submit or ``extra``.

    ``shuffle_partitions`` is a number, or a kind of job in PARTITIONS.
    """
    if isinstance(shuffle_partitions, str):
        shuffle_partitions = PARTITIONS[shuffle_partitions]
    builder = SparkSession.builder.appName(name)
    settings = {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **extra}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
