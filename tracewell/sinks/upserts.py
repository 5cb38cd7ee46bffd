"""Keyed changes of a table, as functions from frames to frames.

The tables that take such changes batch by batch are in :mod:`tracewell.sinks.batches`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordering import rows_at


def _single(n: Column, value: Column, what: str) -> Column:
    """``value``, or an error where a key has ``n`` > 1 rows."""
    return F.when(n <= 1, value).otherwise(F.raise_error(F.lit(what)))


def last_rows(new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row for each key of ``new``: the last by ``order``. Several different rows of a
    key without an order, or if that is equal too, are an error."""
    mark = F.xxhash64(F.to_json(F.struct(*new.columns), {"ignoreNullFields": "false"}))
    last = new
    for c in order:
        last = rows_at(last, keys, c, F.max)
    marked = last.withColumn("_mark", mark)
    # The largest and the smallest hash among the last rows of a key: different if these are.
    ends = marked.groupBy(*keys).agg(F.max("_mark").alias("_most"), F.min("_mark").alias("_least")).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        _single(F.when(F.col("_most") == F.col("_least"), F.lit(1)).otherwise(F.lit(2)), F.col("_most"),
                "several new rows for one key and no order between them").alias("_only"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return marked.join(ends, reduce(Column.__and__, [*same, F.col("_mark") == F.col("_only")])).select(*new.columns).dropDuplicates(list(keys))


def upsert_replace(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Full-row replace: a new row wins over the stored row of its key, and columns
    it does not carry become NULL. See :func:`last_rows` for several new rows of a key."""
    cols = [F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]
    extra = [c for c in order if c not in old.columns]
    kept = last_rows(new.select(*cols, *extra), keys, order).select(*old.columns)
    return kept.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def upsert_add(old: DataFrame, delta: DataFrame, keys: Sequence[str], add: Sequence[str],
               latest: Sequence[str] = ()) -> DataFrame:
    """Additive upsert: counters grow by the deltas, ``latest`` columns keep the maximum, others stay as stored."""
    rest = [c for c in old.columns if c not in {*keys, *add, *latest}]
    cols = [*keys, *add, *latest]
    both = old.select(*cols, *rest).unionByName(delta.select(*cols), allowMissingColumns=True)
    return both.groupBy(*keys).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in add], *[F.max(c).alias(c) for c in latest],
        *[F.first(c, ignorenulls=True).alias(c) for c in rest]).select(*old.columns)


def upsert_max(old: DataFrame, new: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Max-merge upsert."""
    cols = [*keys, *measures]
    return old.select(*cols).unionByName(new.select(*cols)).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in measures])


def _verdicts(decisions: DataFrame, feedback: DataFrame, key: str, ts: str, tie: str, rated: str) -> DataFrame:
    """(_k, _ts, _id, _verdict): the decision that each feedback rates.

    The newest is found by two ``max`` aggregates per key over whole numbers, which a hot key survives.
    """
    pending = decisions.filter(F.col(rated).isNull()).select(F.col(key).alias("_k"), F.col(ts).alias("_ts"), F.col(tie).alias("_id"))
    single = feedback.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.max("verdict").alias("_v")).select(
        "_k", _single(F.col("_n"), F.col("_v"), "several verdicts for one key in one batch").alias("_verdict"))
    newest = pending.groupBy("_k").agg(F.max("_ts").alias("_ts")).join(single, "_k")
    return pending.join(newest, ["_k", "_ts"]).groupBy("_k", "_ts").agg(F.max("_id").alias("_id"), F.max("_verdict").alias("_verdict"))


def rated_rows(decisions: DataFrame, feedback: DataFrame, *, key: str = "query_hash", ts: str = "timestamp",
               tie: str = "id", rated: str = "success") -> DataFrame:
    """The decisions that ``feedback`` rates, rated; see :func:`rate_latest`."""
    hit = _verdicts(decisions, feedback, key, ts, tie, rated)
    joined = decisions.filter(F.col(rated).isNull()).join(
        hit, (F.col(key) == F.col("_k")) & (F.col(ts) == F.col("_ts")) & (F.col(tie) == F.col("_id")))
    return joined.withColumn(rated, F.col("_verdict")).select(*decisions.columns)


def rate_latest(decisions: DataFrame, feedback: DataFrame, *, key: str = "query_hash", ts: str = "timestamp",
                tie: str = "id", rated: str = "success") -> DataFrame:
    """Apply one feedback per key to the newest decision of that key not rated yet.

    ``feedback`` is (key, verdict), one row for a key: several are an error, as their
    order is not known; give them one after the other. ``tie`` identifies a decision.
    """
    hit = _verdicts(decisions, feedback, key, ts, tie, rated)
    joined = decisions.join(hit, (F.col(key) == F.col("_k")) & (F.col(ts) == F.col("_ts"))
                            & (F.col(tie) == F.col("_id")) & F.col(rated).isNull(), "left")
    return joined.withColumn(rated, F.coalesce(rated, "_verdict")).drop("_k", "_ts", "_id", "_verdict")


def tool_usage_delta(events: DataFrame) -> DataFrame:
    """Counter deltas of a batch of tool calls (tool, calls, success, ts)."""
    ok = F.col("success") == 1
    calls = F.coalesce("calls", F.lit(1)) if "calls" in events.columns else F.lit(1)
    return events.groupBy("tool_name").agg(
        F.sum(calls).alias("total_calls"), F.sum(F.when(ok, calls).otherwise(F.lit(0))).alias("success_count"),
        F.sum(F.when(ok, F.lit(0)).otherwise(calls)).alias("failure_count"), F.max("timestamp").alias("last_used"))


def hourly_delta(events: DataFrame, day: Column, hour: Column, sessions: Column, messages: Column) -> DataFrame:
    return events.groupBy(day.alias("date"), hour.alias("hour")).agg(
        sessions.alias("session_count"), messages.alias("message_count"))
