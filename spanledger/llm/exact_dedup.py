"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

The index is a bucketed table with one row per digest ever seen.  New data is
grouped by digest (partial aggregation first, so a text with millions of copies
is one row per task), the groups that the index lacks are found by a sort-merge
anti-join that shuffles only the new side, and are appended.  Texts never move:
the digest of a row is computed where the row is read.

Defined results: a null text equals the empty text; among rows of one document
id the first one staged stays; a null id comes after all others; an empty input
gives no rows and leaves the index as it is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm.common import SPACE, Rows, new_table, stage, text_or_empty

#: Increments in which a query feeds its documents to a fresh index.
INCREMENTS = 2


def digest(text: Column | str = "text") -> Column:
    """SHA-256 of the text with each run of white space made one space, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), f"{SPACE}+", " "), 256))


@dataclass
class DigestIndex:
    """The index table ``name``: digest, keep_id, and which row of which run it stands for."""

    spark: SparkSession
    name: str
    buckets: int

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, run: str) -> None:
        """Add the digests that the index lacks, from ``rows`` of (digest, doc_id, row)."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
        fresh = (
            rows.groupBy("digest")
            .agg(first.alias("first"))
            .select(
                "digest",
                F.col("first.doc_id").alias("keep_id"),
                F.col("first.row").alias("keep_row"),
                F.lit(run).alias("run"),
            )
        )
        if self.exists():
            fresh = fresh.join(self.table().hint("merge"), "digest", "left_anti")
        (
            fresh.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.name)
        )

    def decide(self, rows: DataFrame, run: str) -> DataFrame:
        """Each of ``rows`` with keep_id, group_size and kept.

        Only digests that repeat, in this run or before it, are joined back.  They
        are staged, so that the join with the rows deals out both sides itself and
        can be split where one digest has a large share of the rows.
        """
        groups = stage(
            rows.groupBy("digest")
            .agg(F.count("*").alias("group_size"))
            .join(self.table().hint("merge"), "digest")
            .where((F.col("group_size") > 1) | (F.col("run") != run))
            .select(
                F.col("digest").alias("group"),
                "group_size",
                "keep_id",
                F.when(F.col("run") == run, F.col("keep_row")).alias("keep_row"),
            ),
            "repeated",
        )
        alone = F.col("group").isNull()
        return rows.join(groups, F.col("digest") == F.col("group"), "left").select(
            "row",
            "doc_id",
            "digest",
            F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (alone | F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))).alias("kept"),
        )


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index with as many buckets as shuffles have partitions."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, new_table("digest_index"), buckets)


def increments(rows: DataFrame, parts: int) -> list[DataFrame]:
    """Split by ascending document id, so that an earlier part holds the smaller ids."""
    if parts < 2:
        return [rows]
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.lit(shares).cast("array<double>"))).first()[0]
    if cuts is None:
        return [rows]
    cuts = sorted(set(cuts))
    part = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        part = F.when(F.col("doc_id") <= cut, i).otherwise(part)
    return [rows.where(part == i) for i in range(len(cuts) + 1)]


def deduplicate(rows: DataFrame, index: DigestIndex, parts: int = 1) -> DataFrame:
    """Decisions on staged ``rows`` of (row, doc_id, digest) against the index, which grows by them."""
    run = uuid.uuid4().hex
    for part in increments(rows, parts):
        index.append(part, run)
    return index.decide(rows, run)


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, parts: int = INCREMENTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    index = index or new_index(docs.sparkSession)
    rows = stage(
        docs.select("doc_id", digest().alias("digest"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    return deduplicate(rows, index, parts).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    rows = Rows(docs, "texts")
    digests = stage(rows.values(doc_id=F.col("doc.doc_id"), digest=digest("doc.text")), "digests")
    return rows.without(deduplicate(digests, new_index(docs.sparkSession)).where(~F.col("kept")))
