"""Typed tables, with an empty default where the source is absent."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.schemas import SCHEMAS


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_table(spark: SparkSession, path: str | None, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Table at ``path`` with a fixed schema; an empty frame when there is none.

    The fixed schema spares a pass over file footers and keeps column pruning
    and filter pushdown, since the reader knows every column in advance.
    """
    if path is None:
        return empty(spark, schema)
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if _missing(e):
            return empty(spark, schema)
        raise


def read_store(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Every canonical table under a root directory (a store may be partial)."""
    return {n: read_table(spark, f"{root}/{n}", SCHEMAS[n]) for n in names or list(SCHEMAS)}


def read_database(spark: SparkSession, url: str, table: str, *, key: str, lower: int, upper: int, partitions: int,
                  properties: Mapping[str, str] | None = None) -> DataFrame:
    """Relational table read in parallel ranges of an integer key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions,
                           properties=dict(properties or {}))


def bootstrap(spark: SparkSession, root: str) -> list[str]:
    """Create an empty Parquet table for every canonical schema not there yet."""
    made = []
    for name, schema in SCHEMAS.items():
        try:
            spark.read.parquet(f"{root}/{name}")
        except AnalysisException as e:
            if not _missing(e):
                raise
            empty(spark, schema).write.mode("ignore").parquet(f"{root}/{name}")
            made.append(name)
    return made


def register_views(tables: Mapping[str, DataFrame], as_of: str | None = None) -> None:
    """Expose tables and the stored views to SQL; the subscription summary needs the day ``as_of``."""
    from tracewell.operators import daily, routing, sessions
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    if "daily_stats" in tables:
        d = tables["daily_stats"]
        daily.view_daily_costs(d).createOrReplaceTempView("v_daily_costs")
        daily.view_model_distribution(d).createOrReplaceTempView("v_model_distribution")
        daily.view_token_totals(d).createOrReplaceTempView("v_token_totals")
        if as_of:
            daily.view_subscription(d, as_of=as_of).createOrReplaceTempView("v_subscription_summary")
    if "sessions" in tables:
        sessions.recent_sessions(tables["sessions"]).createOrReplaceTempView("v_recent_sessions")
    if "routing_decisions" in tables:
        routing.accuracy_view(tables["routing_decisions"]).createOrReplaceTempView("v_routing_accuracy")


def parse_json_col(df: DataFrame, col: str, schema: T.DataType | str, alias: str | None = None) -> DataFrame:
    """JSON text column as typed fields; bad text gives NULL fields, not an error."""
    return df.withColumn(alias or col, F.from_json(col, schema))
