"""Raw lifecycle tables: typed, unfiltered reads and the post-load row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, FractionalType, IntegralType, StringType, StructField, StructType

from spanledger.schema import TABLES


#: Where a line that does not fit its schema is kept while it is read.
_BAD_LINE = "_bad_line"


def read_raw(
    spark: SparkSession,
    folder: str,
    fmt: str = "csv",
    prefix: str = "",
    rejected: str | None = None,
) -> dict[str, DataFrame]:
    """The five tables under ``folder`` as ``<prefix><table>.<fmt>``.

    Schemas are given, never inferred, so reading starts no job.  A CSV row
    that does not fit its schema fails the read instead of becoming NULL.  With
    ``rejected``, a folder that all executors share, such rows are left out, and
    written there as they stand in their file (``rejected_rows``, ``rejected_counts``);
    that takes one pass over the tables when they are read here.

    Parquet tables whose dates and numbers are all declared present are read by
    the newer reader, which answers their counts, minima and maxima from the files'
    footers.  That reader fails on a stretch of a column that is all NULL, so the
    subscriptions, whose end dates may be, are scanned.
    """
    tables = {}
    for name, schema in TABLES.items():
        path = f"{folder.rstrip('/')}/{prefix}{name}.{fmt}"
        if fmt == "parquet" and _always_present(schema):
            tables[name] = _with_footers(spark, schema, path)
        elif fmt == "csv" and rejected is not None:
            tables[name] = _without_bad_lines(spark, schema, path, f"{rejected.rstrip('/')}/{name}")
        else:
            reader = spark.read.schema(schema)
            if fmt == "csv":
                reader = reader.options(header=True, mode="FAILFAST", enforceSchema=False)
            tables[name] = reader.format(fmt).load(path)
    return tables


def _always_present(schema: StructType) -> bool:
    """Whether every column whose extremes the footers give is declared NOT NULL."""
    given = (BooleanType, IntegralType, FractionalType, DateType)
    return not any(
        f.nullable and isinstance(f.dataType, given) and not isinstance(f.dataType, DecimalType) for f in schema
    )


def _with_footers(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    settings = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {key: spark.conf.get(key) for key in settings}
    # The reader is chosen when the table is named; the push-down when a plan is made of it, so that
    # setting stays.
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        return spark.read.schema(schema).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before["spark.sql.sources.useV1SourceList"])


def _without_bad_lines(spark: SparkSession, schema: StructType, path: str, rejected: str) -> DataFrame:
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD_LINE}
    lines = spark.read.schema(_extended(schema)).options(**options).csv(path)
    # Only the columns that a query needs are checked, so the conditions name them all.
    read = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in schema.names])) >= 0
    bad = lines.filter(F.col(_BAD_LINE).isNotNull() & read)
    bad.select(F.col("_metadata.file_path").alias("file"), F.col(_BAD_LINE).alias("line")).write.mode(
        "overwrite"
    ).parquet(rejected)
    return lines.filter(F.col(_BAD_LINE).isNull() & read).drop(_BAD_LINE)


def _extended(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(_BAD_LINE, StringType())])


def rejected_rows(spark: SparkSession, rejected: str) -> DataFrame:
    """Every rejected line: table, file, line."""
    schema = "file string, line string"
    parts = [
        spark.read.schema(schema).parquet(f"{rejected.rstrip('/')}/{name}").select(
            F.lit(name).alias("table"), "file", "line"
        )
        for name in TABLES
    ]
    return reduce(DataFrame.unionByName, parts)


def rejected_counts(spark: SparkSession, rejected: str) -> DataFrame:
    """Rejected lines per table and file."""
    return rejected_rows(spark, rejected).groupBy("table", "file").agg(F.count("*").alias("rejected"))


def load_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table after a load."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(f"raw_{name}").alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
