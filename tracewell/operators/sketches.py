"""Mergeable sketches in rollups: quantiles and distinct counts over any range of days.

A rollup holds one small sketch for each group and day, so a range of days is the
merge of some sketches and the events are read once. The exact forms stand beside
them (:func:`~tracewell.operators.windows.percentile_index`, ``count(DISTINCT)``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch, and the error of a rank it keeps to, as a share of all values.
KLL_K, RANK_ERROR = 400, 0.01
#: A distinct sketch is exact up to 2 to this many values; beyond, its error is about 1 / sqrt of that.
THETA_LG = 12


def quantile_rollup(rows: DataFrame, group: str, day: Column, value: str) -> DataFrame:
    """(group, day, n, sketch): a quantile sketch of each group and day; nulls are not values."""
    some = rows.filter(F.col(value).isNotNull())
    return some.groupBy(group, day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("sketch"))


def quantiles(rollup: DataFrame, group: str, at: Sequence[float], *, since: str | None = None, until: str | None = None) -> DataFrame:
    """(group, n, q): quantiles ``at`` of each group over the days from ``since`` to ``until``, both inclusive, as an array."""
    days = rollup
    if since is not None:
        days = days.filter(F.col("day") >= since)
    if until is not None:
        days = days.filter(F.col("day") <= until)
    merged = days.groupBy(group).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", KLL_K).alias("sketch"))
    return merged.select(group, "n", F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in at]).alias("q"))


def distinct_rollup(rows: DataFrame, day: Column, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, day, sketch): a sketch of the distinct values of each day; nulls are not values."""
    return rows.groupBy(*groups, day.alias("day")).agg(F.theta_sketch_agg(value, THETA_LG).alias("sketch"))


def trailing_distinct(rollup: DataFrame, days: int, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, day, n): distinct values of each day of the rollup and the ``days`` - 1 before it.

    Each day's sketch goes to the days it counts for, a bounded number, and is united there.
    """
    dealt = rollup.select(*groups, F.col("day").alias("own"), "sketch", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("ahead"))
    dealt = dealt.select(*groups, F.date_add(F.to_date("own"), F.col("ahead")).cast("string").alias("day"), "sketch", "ahead")
    merged = dealt.groupBy(*groups, "day").agg(F.theta_union_agg("sketch", THETA_LG).alias("sketch"), F.min("ahead").alias("ahead"))
    return merged.filter("ahead = 0").select(*groups, "day", F.theta_sketch_estimate("sketch").alias("n"))
