"""Incremental export of tool events into five differently shaped logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.exprs import basename, first_token, preview

_SESSION_PREFIX = "session_"


def _meta(path: str, kind: str) -> Column:
    return F.try_variant_get("_m", path, kind)


def decode(events: DataFrame) -> DataFrame:
    """Raw events (ts, tool, file_path, session_pwd, metadata text) with decoded fields.

    Broken or missing metadata counts as empty.
    """
    e = events.withColumn("_m", F.try_parse_json("metadata"))
    pwd = F.col("session_pwd")
    return e.select(
        "ts", "tool", F.coalesce("file_path", F.lit("")).alias("file_path"), "session_pwd",
        F.when(pwd.isNotNull() & (pwd != ""), F.substring(basename(pwd), 1, 8)).otherwise(F.lit("unknown"))
        .alias("session"),
        F.coalesce(_meta("$.command", "string"), F.lit("")).alias("command"),
        F.coalesce(_meta("$.success", "boolean"), F.lit(True)).cast("bigint").alias("success"),
        F.coalesce(_meta("$.model", "string"), F.lit("sonnet")).alias("model"),
        F.coalesce(_meta("$.exit_code", "bigint"), F.lit(0)).alias("exit_code"),
        F.when(F.col("_m").isNotNull(), F.col("metadata")).otherwise(F.lit("{}")).alias("metadata"))


def _is_session() -> Column:
    return F.col("tool").startswith(_SESSION_PREFIX)


def session_events(d: DataFrame) -> DataFrame:
    return d.filter(_is_session()).select("ts", F.col("tool").alias("event"), F.col("session_pwd").alias("pwd"),
                                          "metadata")


def tool_usage(d: DataFrame) -> DataFrame:
    return d.filter(~_is_session()).select("ts", "tool", "session", "model", F.lit("lake").alias("source"),
                                           "file_path", "command", "success")


def tool_success(d: DataFrame) -> DataFrame:
    return d.filter(~_is_session()).select("ts", "tool", "success", "exit_code", "session")


def command_usage(d: DataFrame) -> DataFrame:
    """Shell commands only: first word and the command cut to 200 characters."""
    shell = d.filter((F.col("tool") == "Bash") & (F.col("command") != ""))
    return shell.select("ts", first_token("command").alias("command"), preview("command", 200).alias("full_command"),
                        "success", "session")


def activity(d: DataFrame) -> DataFrame:
    return d.filter(~_is_session()).select(
        "ts", F.lit("tool_use").alias("type"), "tool", "file_path", preview("command", 200).alias("command"),
        "success", F.col("session_pwd").alias("pwd"))


SHAPES = {"session_events": session_events, "tool_usage": tool_usage, "tool_success": tool_success,
          "command_usage": command_usage, "activity": activity}


def routes(root: str) -> dict:
    """Fan-out routes for :func:`tracewell.sinks.panels.fan_out`."""
    return {n: (lambda batch, f=f: f(decode(batch)), f"{root}/{n}") for n, f in SHAPES.items()}
