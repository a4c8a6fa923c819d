"""A training corpus from ``documents``: filter, deduplicate, mix, encode.

Each stage takes (spark, docs, folder) and returns a table; ``run`` writes each
as Parquet in the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanledger.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from spanledger.llm.common import settled, table


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the word and line rules and the robust outlier test keep."""
    return quality_rules.passing(docs)


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each text, that of the smallest id."""
    return exact_dedup.without_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id."""
    return simhash.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("mixing", mix),
    ("bpe", encode),
]

#: The classes of near copies and the outlier test cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, used = table(spark, sf_dir, "documents"), []
    for name, step in STAGES:
        # What a stage leaves on its way goes when its result is written, and so does its input.
        docs = settled(lambda step=step, docs=docs: step(spark, docs, sf_dir), name.replace(" ", "-"), used)
        used = [docs]
    return docs
