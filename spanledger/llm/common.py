"""Shared parts: staging in the shared folder, row tags, text rules of the contracts."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"

#: Row keys that are broadcast, at about 80 bytes each in memory.
BROADCAST_ROWS = 400_000

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose executors do not see that folder, install the package
    there or pass it with --py-files.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session, as in tests, gets a temporary folder of its own; on a
    cluster executors would not see that, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spanledger-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Made(threading.local):
    """What the calls of ``settled`` that are under way in a thread have made, innermost last."""

    def __init__(self):
        self.folders: list[list[str]] = [[]]
        self.tables: list[list[str]] = [[]]


MADE = Made()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.folders[-1].append(path)
    return path


def new_table(name: str) -> str:
    table_name = f"{name}_{uuid.uuid4().hex}"
    MADE.tables[-1].append(table_name)
    return table_name


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, no lineage to lose."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def release(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let go the shuffles that made them."""
    for df in staged:
        discard(df.sparkSession, df.staged_at)
    let_go(staged[0].sparkSession)


def let_go(spark: SparkSession) -> None:
    """Have Spark remove the files of shuffles that no table needs any more.

    It does when the driver's collector finds them unreachable, which by itself can take as long as
    the job.  Python's bridge tells the driver what Python has dropped within about a second; Spark
    removes the files in the background, slowly once executors are busy again, so that is waited for.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1.5)
        spark._jvm.System.gc()
    time.sleep(1)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged folders through the file system that holds them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        for made in MADE.folders:
            if path in made:
                made.remove(path)


def settled(make: Callable[[], DataFrame], name: str, used: Sequence[DataFrame] = ()) -> DataFrame:
    """What ``make`` returns, staged; the folders and tables made on the way are removed, also when it fails.

    ``used`` are older staged tables that are not needed any more once the result is written.
    """
    MADE.folders.append([])
    MADE.tables.append([])
    done = None
    try:
        done = stage(make(), name)
        for df in used:
            discard(df.sparkSession, df.staged_at)
        return done
    finally:
        folders, tables = MADE.folders.pop(), MADE.tables.pop()
        spark = SparkSession.active()
        if done is not None:
            folders.remove(done.staged_at)
            MADE.folders[-1].append(done.staged_at)
        discard(spark, *folders)
        for table_name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table_name}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


class Rows:
    """Documents whose rows have a key, ``row``, that is the same however often they are read.

    It is the file and the place in it, so documents read from Parquet, as a
    pipeline's stages get them, need no copy; others are staged first.  The
    columns of the input sit inside ``doc``, so no name of theirs can clash.
    """

    def __init__(self, docs: DataFrame, name: str):
        doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
        plan = docs._jdf.queryExecution().analyzed()
        read = plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().toString() == "parquet"
        if not read or "_metadata" in docs.columns:
            docs = stage(docs.select(doc), name)
            doc = F.col("doc")
        place = F.struct(
            F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
        )
        self.docs = docs.select(doc, place.alias("row"))

    def values(self, **computed: Column) -> DataFrame:
        """``row`` and columns computed of ``doc``."""
        return self.docs.select("row", *[column.alias(name) for name, column in computed.items()])

    def without(self, dropped: DataFrame) -> DataFrame:
        """The documents whose rows are not in ``dropped``, with their own columns."""
        return self.docs.join(small(dropped.select("row"), "dropped"), "row", "left_anti").select("doc.*")

    def with_values(self, values: DataFrame) -> DataFrame:
        """``doc`` with the columns of ``values`` (row and others), where there are some."""
        return self.docs.join(small(values, "values"), "row")


def small(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` staged, and broadcast if they are counted to be few; else a join shuffles both sides by row."""
    rows = stage(rows, name)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
