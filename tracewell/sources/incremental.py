"""Reading only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def since(df: DataFrame, ts: str, high_water: int) -> DataFrame:
    """Rows above a stored high-water mark; the literal bound reaches the scan."""
    return df.filter(F.col(ts) > high_water)


def new_rows(df: DataFrame, target: DataFrame, ts: str) -> DataFrame:
    """Rows newer than the newest row of ``target`` (all rows when it is empty).

    The bound is a scalar subquery, evaluated once before the scan.
    """
    newest = target.agg(F.coalesce(F.max(ts), F.lit(0)).alias("hw")).scalar()
    return df.filter(F.col(ts) > newest)


def missing_rows(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet; unlike :func:`new_rows` a rerun of the
    same day loses nothing."""
    return df.join(target.select(key).distinct(), key, "left_anti")


def high_water(df: DataFrame, ts: str) -> DataFrame:
    """The new mark after processing ``df``, as a one-row frame."""
    return df.agg(F.max(ts).alias("last_sync_ts"))
