"""Connected components of an edge table, by alternating stars in Spark.

Each round joins every node to its smallest neighbour and rewires edges to it
(large star, then small star), so the number of rounds grows with the logarithm
of a component's diameter.  Minima are aggregated before they are shuffled and
the joins can be split, so a node with very many neighbours does not meet one
task; each round is a table in the shared folder, so a lost executor costs only
its share of one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("least"))
    return (
        both.where("b > a")
        .join(least, "a")
        .where("b <> least")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    joined = edges.join(least, "a")
    moved = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Number and digest of a set of edges, whatever their order."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not itself the smallest of its component.

    ``a`` and ``b`` are of one ordered type; loops and repeats do no harm.
    """
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = None
    while (state := _state(now)) != seen:
        seen, now = state, stage(_small_star(_large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
