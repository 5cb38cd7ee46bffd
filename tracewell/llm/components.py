"""Connected components of an undirected graph given as pairs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import checkpointed


def _towards_minimum(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest node around it.

    ``larger_only`` (large star) moves the neighbours above the node, else (small
    star) the node and its neighbours below. The minimum is a hash aggregate with
    map-side combine; the join back may meet a node with very many neighbours, whose
    rows adaptive execution splits.
    """
    if larger_only:
        around = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = around.join(low, "a")
    moved = near.filter(F.col("b") > F.col("a")) if larger_only else near
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger_only:
        out = out.union(low.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def stars(pairs: DataFrame) -> DataFrame:
    """(a, b) with ``b`` the smallest node of the component of ``a``, for every node but the smallest.

    ``pairs`` has two columns of one ordered type; its pairs may repeat and turn
    around, a node linked to itself alone is in no row. The number of rounds grows
    with the logarithm of the longest path. Each round is written to the checkpoint
    folder, which cuts the lineage; only its row count and a hash reach the driver.
    """
    a, b = pairs.columns
    now = checkpointed(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        now = checkpointed(_towards_minimum(_towards_minimum(now, True), False))
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return now
        before = mark
