"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are laid end to end in shuffled order (by the digest of
the document id) and cut into blocks of equal length in words.  Slots of the mix
are the points of a golden-ratio sequence, mapped through the cumulative weights
of the sources: any stretch of slots holds each source near its share.  Slots
are ranked within their source and rank r takes block r modulo the number of
blocks, so a source goes through all its blocks before it repeats one, and the
third pass is never begun.

No step gathers a source in one task: positions and ranks are running sums over
pieces of bounded size, plus running sums over one row per piece.  Points meet
weights by an equi-join on cells of the unit interval.  Windows over all sources
see one row per source.

Defined results: a null or empty text has size 0 and is never taken; the null
source comes last; rows of one id and size are interchangeable; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanledger.llm.common import SPACE, SPACE_CHARS, Rows, stage, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words in a block at most; documents and slots that are put in order at a time.
BLOCK = 32
DOCUMENTS_AT_A_TIME = 4096
SLOTS_AT_A_TIME_BITS = 16
#: Points are multiples of 2**-40; the step is the golden ratio's fraction, made odd.
POINT_BITS = 40
GOLDEN = int(2**POINT_BITS * 0.6180339887498949) | 1
CELL_BITS = 12
#: Fixed point of a source's share of the slots.
FINE = 1024


def n_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"{SPACE}+"))).cast("long")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: its number, size, target in words, and block length and count.

    Sharing what is above a source's limit among the others until none is above
    ends where every source has the lesser of its limit and a common level times
    its weight; in order of limit by weight, those before the level are at it.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("src", F.row_number().over(in_order) - 1).withColumn(
        "weight", F.get(F.array(*map(F.lit, weights)), F.col("src") % len(weights)).cast("long")
    )
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        numbered.withColumn("limit", most * F.col("source_size"))
        .withColumn("total", share * F.sum("source_size").over(every))
        .withColumn("taken_before", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("taken_before")) / F.sum("weight").over(rest))
        .withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    )
    # Every source that is not full has the level of the first such one.
    rank = F.struct(F.col("limit") / F.col("weight"), "src")
    first_open = F.min_by("level", F.when(~F.col("full"), rank)).over(every)
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        F.least(F.col("limit").cast("double"), first_open * F.col("weight"))
    )
    return (
        level.withColumn("target", target)
        .withColumn(
            "block",
            F.when(
                F.col("source_size") > 0, F.ceil(F.col("source_size") / F.ceil(F.col("source_size") / BLOCK))
            )
            .otherwise(1)
            .cast("long"),
        )
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
        .select("src", "source", "source_size", "target", "block", "blocks")
    )


def intervals(sources: DataFrame) -> DataFrame:
    """The part of the unit interval, in points, that each source's slots fall in."""
    slots = F.coalesce(
        F.round(F.col("target") * F.col("blocks") / F.when(F.col("source_size") > 0, F.col("source_size")) * FINE), F.lit(0)
    ).cast("long")
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()

    def point(total: Column) -> Column:
        return F.floor(total.cast("double") / F.col("all_slots") * 2.0**POINT_BITS).cast("long")

    return (
        sources.withColumn("slots", slots)
        .withColumn("upto", F.sum("slots").over(upto))
        .withColumn("all_slots", F.sum("slots").over(every))
        .where("slots > 0")
        .withColumn("low", point(F.col("upto") - F.col("slots")))
        .withColumn("high", point(F.col("upto")))
    )


def points(spark: SparkSession, n: int) -> DataFrame:
    """(slot, point): the first n points of the golden-ratio sequence."""
    whole, half = 1 << POINT_BITS, POINT_BITS // 2
    low, high = F.col("id") % (1 << half), F.shiftright("id", half)
    step = (GOLDEN << half) % whole
    at = ((high * F.lit(step)) % F.lit(whole) + low * F.lit(GOLDEN)) % F.lit(whole)
    return spark.range(n).select(F.col("id").alias("slot"), at.alias("point"))


def schedule(spark: SparkSession, sources: DataFrame, most: int = MOST) -> DataFrame:
    """(slot, src, pass, block_no): which block each slot of the mix takes, ``sources`` staged."""
    spans = intervals(sources)
    n = spans.agg(F.max("all_slots")).first()[0]
    shift = POINT_BITS - CELL_BITS
    cells = spans.select(
        "src",
        "blocks",
        "low",
        "high",
        F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.greatest("low", F.col("high") - 1), shift))).alias("cell"),
    )
    slots = (
        points(spark, -(-(n or 0) // FINE))
        .withColumn("cell", F.shiftright("point", shift))
        .join(cells, "cell")
        .where("point >= low and point < high")
        .select("slot", F.shiftright("slot", SLOTS_AT_A_TIME_BITS).alias("piece"), "src", "blocks")
    )
    counted = slots.groupBy("src", "piece").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("src").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("src", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("src", "piece").orderBy("slot")
    rank = F.col("offset") + F.row_number().over(within) - 1
    return (
        slots.join(offsets, ["src", "piece"])
        .withColumn("rank", rank)
        .select(
            "slot",
            "src",
            F.expr("rank div blocks").alias("pass"),
            (F.col("rank") % F.col("blocks")).alias("block_no"),
        )
        .where(F.col("pass") < most)
    )


def positions(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with src, block and where each document starts among its source's shuffled words."""
    pieces = max(1, rows.count() // DOCUMENTS_AT_A_TIME)
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    leading = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    tagged = (
        rows.join(
            sources.select(F.col("source").alias("of"), "src", "source_size", "target", "block"),
            F.col("source").eqNullSafe(F.col("of")),
        )
        .withColumn("digest", order)
        .withColumn("piece", F.shiftright(leading * F.lit(pieces), 32))
    )
    counted = tagged.groupBy("src", "piece").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("src").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("src", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = (
        Window.partitionBy("src", "piece")
        .orderBy("digest", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    start = F.col("offset") + F.sum("size").over(within) - F.col("size")
    return tagged.join(offsets, ["src", "piece"]).withColumn("start", start)


def mix(rows: DataFrame) -> DataFrame:
    """``rows``, staged (row, doc_id, source, size), with source_size, target and taken."""
    spark = rows.sparkSession
    sources = stage(source_targets(rows), "sources")
    copies = schedule(spark, sources).groupBy("src", "block_no").agg(F.count("*").alias("copies"))
    placed = stage(
        positions(rows, sources).select("row", "doc_id", "size", "source_size", "target", "src", "block", "start"), "placed"
    )
    end = F.col("start") + F.col("size")
    shares = (
        placed.where("size > 0")
        .withColumn("block_no", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")))
        .withColumn(
            "words",
            F.least(end, (F.col("block_no") + 1) * F.col("block")) - F.greatest("start", F.col("block_no") * F.col("block")),
        )
        .select("row", "src", "block_no", "words")
    )
    taken = shares.join(copies, ["src", "block_no"]).groupBy("row").agg(F.sum(F.col("words") * F.col("copies")).alias("taken"))
    return placed.join(taken, "row", "left").select(
        "row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = stage(
        docs.select("doc_id", "source", n_words(text_or_empty()).alias("size"), F.monotonically_increasing_id().alias("row")),
        "sizes",
    )
    return mix(rows).drop("row")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix: each document whole, as often as the words taken of it make it up, rounded."""
    rows = Rows(docs, "mixed")
    sizes = rows.values(doc_id=F.col("doc.doc_id"), source=F.col("doc.source"), size=n_words(text_or_empty("doc.text")))
    times = F.round(F.col("taken") / F.when(F.col("size") > 0, F.col("size"))).cast("int")
    taken = mix(stage(sizes, "sizes")).select("row", times.alias("times")).where("times > 0")
    return (
        rows.with_values(taken)
        .withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select("doc.*")
    )
