"""Top-k, ordinal sorts, unions and de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _desc(names: Sequence[str]) -> list[Column]:
    return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n).asc() for n in names]


def top(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows; a leading ``-`` sorts a column descending.

    Runs as one bounded heap per task and a merge, not as a global sort. Every
    caller ends ``order`` with a unique column, so the cut is deterministic.
    """
    return df.orderBy(*_desc(order)).limit(n)


def latest(df: DataFrame, ts: str, n: int, tie: str = "id") -> DataFrame:
    """Newest ``n`` rows; also the meaning given to "the last n lines"."""
    return top(df, n, f"-{ts}", f"-{tie}")


def tail(df: DataFrame, ts: str, n: int | None, tie: str = "id") -> DataFrame:
    """``latest`` with ``None`` for no limit."""
    return df if n is None else latest(df, ts, n, tie)


def recent_ascending(df: DataFrame, order: str, n: int) -> DataFrame:
    """Newest ``n`` rows shown oldest first."""
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def counter(df: DataFrame, col: str | Column, alias: str, n: int | None = None, count: str = "n") -> DataFrame:
    """Frequency table, most frequent first."""
    c = F.col(col) if isinstance(col, str) else col
    out = df.groupBy(c.alias(alias)).agg(F.count(F.lit(1)).alias(count))
    return out if n is None else top(out, n, f"-{count}", alias)


#: Deal stages in pipeline order.
DEAL_STAGES = ("prospect", "contacted", "meeting", "proposal", "negotiation", "won", "lost")


def ordinal(col: str, values: Sequence[str]) -> Column:
    """Position of a value in a given order, NULL for others."""
    out = F.when(F.col(col) == values[0], F.lit(1))
    for i, v in enumerate(values[1:], start=2):
        out = out.when(F.col(col) == v, F.lit(i))
    return out.cast("bigint")


def ordinal_top(df: DataFrame, col: str, values: Sequence[str], n: int, *then: str) -> DataFrame:
    """First ``n`` rows by ordinal position, then by ``then``."""
    return top(df.withColumn("position", ordinal(col, values)), n, "position", *then)


def union_events(sources: Sequence[tuple[DataFrame, Mapping[str, Column | str]]]) -> DataFrame:
    """Union-all of several sources projected to one shape."""
    parts = [df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])
             for df, cols in sources]
    return reduce(DataFrame.unionByName, parts)


def distinct_values(df: DataFrame, **cols: str | Column) -> DataFrame:
    """Distinct values of several columns in one scan, one row per (field, value)."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(name).alias("field"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("value"))
        for name, c in cols.items()]))
    return df.select(cells.alias("c")).select("c.*").filter(F.col("value").isNotNull()).distinct()


def packed(high: str | Column, low: str | Column) -> Column:
    """Two whole numbers as one decimal that orders like the pair; a null is the smallest number.

    A pair as a struct makes an aggregate sort its input, a decimal is a state of fixed
    width. ``high`` may have 18 digits and a little more: beyond 5e18 either way is an error.
    """
    high, low = (F.col(c) if isinstance(c, str) else c for c in (high, low))
    wide = F.coalesce(high.cast("decimal(19,0)"), F.lit("-5000000000000000000").cast("decimal(19,0)"))
    return (wide * F.lit(str(1 << 64)).cast("decimal(20,0)")
            + F.coalesce(low.cast("decimal(20,0)"), F.lit(str(-1 << 63)).cast("decimal(20,0)"))).cast("decimal(38,0)")


def rows_at(df: DataFrame, keys: Sequence[str], at: str, best: Callable[[str], Column]) -> DataFrame:
    """Rows of ``df`` whose ``at`` is the ``best`` (an aggregate, as ``F.max``) of their key; ties all stay.

    ``at`` has fixed width, so a hash aggregate finds it, combined in the tasks, and wide
    columns stay out of it: a join fetches the rows. A null is a key like any other.
    """
    found = df.groupBy(*keys).agg(best(at).alias("_best")).withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return df.join(found, reduce(Column.__and__, [*same, F.col(at).eqNullSafe(F.col("_best"))])).select(*df.columns)


def newest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per key, the one with the highest version: one or two whole numbers.

    Of rows equal in it the one with the largest JSON stays; only rows with the highest
    version pass through a sorting aggregate.
    """
    rest = [c for c in df.columns if c not in keys]
    at = F.col(version[0]) if len(version) == 1 else packed(*version)
    top = rows_at(df.withColumn("_at", at), keys, "_at", F.max)
    row = F.struct(*rest)
    out = top.groupBy(*keys).agg(F.max_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("_r"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def logs_with_counts(logs: Mapping[str, tuple[DataFrame, str, str]], n: int) -> DataFrame:
    """Row count of each log and of the tail a panel would show."""
    parts = []
    for name, (df, ts, tie) in logs.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("log"), "rows", F.least("rows", F.lit(n)).alias("shown")))
    return reduce(DataFrame.unionByName, parts)
