"""Windows over time, optional predicates and reshaping projections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.exprs import nonblank, preview, zero_if_null

DAY = 86400


def within_days(df: DataFrame, ts: str, days: int, *, as_of: int) -> DataFrame:
    """Events newer than ``days`` before ``as_of`` (epoch seconds, exclusive)."""
    return df.filter(F.col(ts) > F.lit(as_of - days * DAY))


def within_dates(df: DataFrame, day: str, days: int, *, as_of: str) -> DataFrame:
    """Rows dated on or after ``as_of - days`` (calendar days, inclusive)."""
    start = F.date_sub(F.lit(as_of).cast("date"), days).cast("string")
    return df.filter(F.col(day) >= start)


def due_within(df: DataFrame, day: str, days: int, *, as_of: str) -> DataFrame:
    """Rows dated on or before ``as_of + days``."""
    return df.filter(F.col(day) <= F.date_add(F.lit(as_of).cast("date"), days).cast("string"))


def on_day(df: DataFrame, day: str, as_of: str) -> DataFrame:
    return df.filter(F.col(day) == as_of)


def not_before(df: DataFrame, ts: str, cutoff: int) -> DataFrame:
    """Plausibility cut: drop events stamped before a fixed instant."""
    return df.filter(F.col(ts) > cutoff)


def where_equal(df: DataFrame, **values: object) -> DataFrame:
    """Equality filters for the arguments that are given (not None)."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def open_or_recent(df: DataFrame, ended: str, minutes: int, *, as_of: int) -> DataFrame:
    """Rows still open, or closed within the last ``minutes``."""
    end = F.col(ended)
    return df.filter(end.isNull() | (end > as_of - minutes * 60))


def text_contains(df: DataFrame, col: str, needle: str) -> DataFrame:
    """Case-insensitive substring filter."""
    return df.filter(F.lower(F.col(col)).contains(needle.lower()))


def has_prefix(col: str, prefix: str) -> Column:
    return F.col(col).startswith(prefix)


def rename_with_zero(df: DataFrame, names: Mapping[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Project columns under new names, NULL measures as 0."""
    return df.select(*keep, *[zero_if_null(old).alias(new) for old, new in names.items()])


def sessions_since(sessions: DataFrame, days: int = 30, *, as_of: int, project: str | None = None) -> DataFrame:
    """Sessions started in the last ``days``, newest first."""
    recent = sessions.filter(F.col("started_at") >= as_of - days * DAY)
    return where_equal(recent, project_path=project).orderBy(F.col("started_at").desc(), F.col("id"))


def predictions_from_scores(scores: DataFrame) -> DataFrame:
    """Score log reshaped to prediction rows; rows without a timestamp are dropped."""
    model = F.coalesce("model", F.lit("sonnet"))
    return scores.filter(F.col("ts").isNotNull() & (F.col("ts") != 0)).select(
        "ts",
        preview(F.coalesce("query", F.lit("")), 50).alias("query"),
        model.alias("predicted_model"),
        model.alias("actual_model"),
        F.coalesce("dqScore", F.lit(0.5)).alias("dq_score"),
        F.coalesce("complexity", F.lit(0.5)).alias("complexity"),
        F.lit(1).cast("bigint").alias("correct"))


def flagged_notes(notes: DataFrame, project: str, keywords: tuple[str, str], n: int = 50) -> DataFrame:
    """The newest ``n`` notes of a project, flagged when the text holds both keywords."""
    text = F.lower("content")
    latest = notes.filter(F.col("project") == project).orderBy(F.col("date").desc(), F.col("id")).limit(n)
    both = text.contains(keywords[0].lower()) & text.contains(keywords[1].lower())
    return latest.select("id", "category", "date", both.cast("bigint").alias("flagged"))


def alias_field(*names: str, default: str) -> Column:
    """First of several alternative field names that holds a value."""
    return nonblank(*names, default=default)
