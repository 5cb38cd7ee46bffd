"""Session transcripts: one JSON-lines file per session, nested and mixed in shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.exprs import event_ts
from tracewell.sources.jsonl import FILE, RAW, read_lines

_USAGE = {"input_tokens": "input_tokens", "output_tokens": "output_tokens",
          "cache_read_tokens": "cache_read_input_tokens", "cache_create_tokens": "cache_creation_input_tokens"}


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _items(content: Column) -> Column:
    return F.try_variant_get(content, "$", "array<variant>")


def content_text(content: Column) -> Column:
    """Text of message content: a string, a list of objects, or a list of strings."""
    parts = F.transform(_items(content), lambda i: F.when(_is_string(i), _get(i, "$", "string")).otherwise(
        F.coalesce(_get(i, "$.text", "string"), F.lit(""))))
    return F.when(_is_string(content), _get(content, "$", "string")).otherwise(F.array_join(parts, " "))


def tool_names(content: Column) -> Column:
    """Names of the tool_use items, ``unknown`` where an item has none."""
    used = F.filter(_items(content), lambda i: F.coalesce(_get(i, "$.type", "string") == "tool_use", F.lit(False)))
    names = F.transform(used, lambda i: F.coalesce(_get(i, "$.name", "string"), F.lit("unknown")))
    return F.coalesce(names, F.array().cast("array<string>"))


def parse_turns(lines: DataFrame) -> DataFrame:
    """Canonical turns from raw transcript lines (``_raw``, ``_file``).

    The session id is the stem of the file name. ``turn`` orders the entries of
    a session by their instant, whatever form it is written in, and within it by the
    text, because the position of a line in its file is not kept by a distributed read.
    """
    v = lines.withColumn("_v", F.try_parse_json(RAW)).filter(F.col("_v").isNotNull())
    top, msg = F.col("_v"), F.try_variant_get("_v", "$.message", "variant")
    shaped = v.select(
        F.regexp_replace(FILE, r"\.[^.]*$", "").alias("session_id"),
        _get(top, "$.timestamp", "string").alias("_ts"), _get(top, "$.type", "string").alias("type"),
        msg.alias("_m"), RAW)
    content = F.try_variant_get("_m", "$.content", "variant")
    text = F.when(_is_string(F.col("_m")), _get(F.col("_m"), "$", "string")).otherwise(content_text(content))
    names = F.when(F.col("type") == "assistant", tool_names(content)).otherwise(F.array().cast("array<string>"))
    at = event_ts("_ts")
    return shaped.select(
        "session_id", F.unix_timestamp(at).alias("timestamp"), "type", text.alias("text"),
        _get(F.col("_m"), "$.model", "string").alias("model"), names.alias("tool_names"),
        F.size(names).cast("bigint").alias("tools"), _get(F.col("_m"), "$.stopReason", "string").alias("stop_reason"),
        *[_get(F.col("_m"), f"$.usage.{src}", "bigint").alias(n) for n, src in _USAGE.items()],
        F.struct(at.alias("at"), F.col("_ts"), F.xxhash64(RAW)).alias("turn"))


def read_transcripts(spark: SparkSession, directory: str) -> DataFrame:
    """All transcripts below a directory, at any depth, unparseable lines skipped."""
    return parse_turns(read_lines(spark, directory, recursive=True, glob="*.jsonl"))


def explode_tool_use(turns: DataFrame) -> DataFrame:
    """One row per tool call of a turn."""
    return turns.select("session_id", "timestamp", F.explode("tool_names").alias("tool_name"))
