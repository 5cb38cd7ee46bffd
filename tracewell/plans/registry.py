"""Query registry and the small SQL vocabulary used by the oracle texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans.bindings import Bindings, with_clause

# Instants every query is pinned to; they replace a hidden "now".
EVENTS_NOW = 1706659200            # 2024-01-31 00:00:00, just after the event log ends
EVENTS_DAY = "2024-01-31"
LINES_NOW = 1004572800             # 2001-11-01 00:00:00, near the end of the line items
LINES_DAY = "2001-11-01"


@dataclass(frozen=True)
class Query:
    run: Callable[[Bindings], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, root: str) -> DataFrame:
        return self.run(Bindings(spark, root))

    def oracle(self) -> str | None:
        return with_clause(self.sql) if self.sql else None


QUERIES: dict[str, Query] = {}


def query(name: str, run: Callable[[Bindings], DataFrame], sql: str | None = None) -> None:
    """Register a query and the SQL that defines its result."""
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name] = Query(run, sql)


# ---- oracle SQL helpers ----------------------------------------------------

def r(expr: str, digits: int = 0) -> str:
    return f"(floor(CAST({expr} AS DOUBLE) * 1e{digits} + 5e-1) / 1e{digits})"


def dec(expr: str) -> str:
    """The shortest decimal text of a double, as an exact number."""
    return f"CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,12))"


def dbl(expr: str) -> str:
    return f"CAST(CAST({expr} AS VARCHAR) AS DOUBLE)"


def dsum(expr: str) -> str:
    """Exact sum; nothing is rounded."""
    return dbl(f"sum({dec(expr)})")


def avg(expr: str) -> str:
    return f"({dsum(expr)} / nullif(count({expr}), 0))"


def pct(part: str, total: str, digits: int = 1) -> str:
    return r(f"(({part}) * 1e2 / nullif({total}, 0))", digits)


def isum(expr: str) -> str:
    return f"CAST(sum({expr}) AS BIGINT)"


def cif(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def day(ts: str) -> str:
    return f"CAST(DATE '1970-01-01' + CAST({ts} // 86400 AS INTEGER) AS VARCHAR)"


def hour(ts: str) -> str:
    return f"(({ts} // 3600) % 24)"


def fixed(expr: str, digits: int) -> str:
    scale = 10**digits
    units = f"CAST(floor(CAST({expr} AS DOUBLE) * {scale}e0 + 5e-1) AS BIGINT)"
    if digits == 0:
        return f"CAST({units} AS VARCHAR)"
    return f"(CAST({units} // {scale} AS VARCHAR) || '.' || lpad(CAST({units} % {scale} AS VARCHAR), {digits}, '0'))"
