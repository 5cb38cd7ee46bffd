"""Transcript turns folded into sessions, days and hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import scoring
from tracewell.functions.exprs import MODEL_TIERS, day_of, hour_of, rnd, tier_of
from tracewell.operators.joins import prefer_nonzero, preserve_existing
from tracewell.operators.ordering import counter, rows_at

# Assumed defaults; the per-message price list is a job parameter. Tokens one message saves are a fixed value.
COST_PER_MESSAGE = {"opus": 0.12, "sonnet": 0.05, "haiku": 0.01}
TOKENS_SAVED_PER_MESSAGE = 1500


def fold_sessions(turns: DataFrame) -> DataFrame:
    """One row per session from its turns.

    A single hash aggregate in which every output has a state of fixed width (counts,
    a 24-bit mask of hours, the turn of the first text), so even a session that
    holds a large part of all turns is combined on the map side. A join fetches the
    first texts, cut to the title length; of several of one turn the smallest counts.
    """
    assistant, user = F.col("type") == "assistant", F.col("type") == "user"
    tier = tier_of("model", default=None)
    head = F.when(user & (F.length("text") > 3), F.substring("text", 1, 100))
    rows = turns.select("session_id", "turn", "timestamp", "type", "model", "tools", "stop_reason", head.alias("_head"))
    dated = F.col("timestamp").isNotNull()
    hour_bit = F.call_function("shiftleft", F.lit(1), hour_of("timestamp").cast("int"))
    folded = rows.groupBy("session_id").agg(
        F.min_by("timestamp", F.when(dated, F.col("turn"))).alias("_at"),
        F.count_if(user | assistant).alias("messages"),
        F.coalesce(F.sum(F.when(assistant, F.col("tools"))), F.lit(0)).alias("tools"),
        F.coalesce(F.bit_or(hour_bit), F.lit(0)).alias("_mask"),
        *[F.count_if(assistant & (tier == m)).alias(m) for m in MODEL_TIERS],
        F.coalesce(F.bool_or(assistant & (F.col("stop_reason") == "error")), F.lit(False)).alias("has_error"))
    texts = rows_at(rows.filter(F.col("_head").isNotNull()).select("session_id", "turn", "_head"), ["session_id"], "turn", F.min)
    firsts = texts.groupBy(F.col("session_id").alias("_id")).agg(F.min("_head").alias("_first"))
    folded = folded.filter(F.col("_at").isNotNull()).join(firsts, F.col("session_id").eqNullSafe(F.col("_id")), "left")
    hours = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.getbit("_mask", h) == 1).cast("array<bigint>")
    return folded.select(
        "session_id", day_of("_at").alias("date"), "messages", "tools", hours.alias("hours"), *MODEL_TIERS,
        F.substring("_first", 1, 50).alias("title"), F.substring("_first", 1, 80).alias("intent"), "has_error")


def score_sessions(folded: DataFrame) -> DataFrame:
    """Outcome, model efficiency, estimated quality and main model of each session."""
    calls = {m: F.col(m) for m in MODEL_TIERS}
    most = F.greatest(*calls.values())
    primary = (F.when((F.col("opus") == most), F.lit("opus")).when(F.col("sonnet") == most, F.lit("sonnet"))
               .otherwise(F.lit("haiku")))
    return folded.withColumns({
        "outcome": scoring.outcome("messages", "tools", F.col("has_error")),
        "model_efficiency": scoring.efficiency(calls),
        "quality": scoring.quality_estimate("messages", "tools"),
        "primary_model": primary})


def keep_quality(scored: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored quality where there is one, else the estimate. ``stored`` is (session_id, quality)."""
    return preserve_existing(scored, stored, "session_id", "quality")


def sessions_to_daily(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("date").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("messages"), F.sum("tools").alias("tools"),
        *[F.sum(m).alias(m) for m in MODEL_TIERS])


def hour_presence(sessions: DataFrame) -> DataFrame:
    """Sessions active in each hour; a session counts once per hour it touched."""
    return sessions.select(F.explode("hours").alias("hour")).groupBy("hour").agg(F.count(F.lit(1)).alias("sessions"))


def usage_totals(turns: DataFrame) -> DataFrame:
    """Token sums over assistant usage records; missing fields count 0."""
    z = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))
    rows = turns.filter(F.col("type") == "assistant")
    return rows.agg(z("input_tokens").alias("input"), z("output_tokens").alias("output"),
                    z("cache_read_tokens").alias("cache_read"), z("cache_create_tokens").alias("cache_create"))


def cache_hit_rate(usage: DataFrame) -> DataFrame:
    """Share of input read from the cache, as fraction and percent."""
    total = F.col("cache_read") + F.col("input") + F.col("cache_create")
    share = F.col("cache_read").cast("double") / F.when(total == 0, F.lit(1)).otherwise(total)
    return usage.select(rnd(share, 4).alias("cache_hit_rate"), rnd(share * 100, 2).alias("reduction_pct"))


def message_value(calls: dict[str, Column] | None = None) -> Column:
    """Value of a row's model calls at the per-message rates."""
    calls = calls or {m: F.col(m) for m in MODEL_TIERS}
    return sum((calls[m] * F.lit(p) for m, p in COST_PER_MESSAGE.items()), F.lit(0.0))


def pack_savings(daily: DataFrame, stored: DataFrame) -> DataFrame:
    """Daily savings: the stored cost, or the per-message estimate when it is 0.

    ``stored`` is (date, cost_estimate) of the daily table.
    """
    s = stored.filter(F.col("cost_estimate") > 0).select("date", F.col("cost_estimate").alias("_stored"))
    cost = prefer_nonzero("_stored", message_value(), F.col("messages") > 0)
    return daily.join(s, "date", "left").select(
        "date", "sessions", "messages", (F.col("messages") * TOKENS_SAVED_PER_MESSAGE).alias("token_savings"),
        rnd(cost, 2).alias("cost_savings"))


def model_message_costs(sessions: DataFrame) -> DataFrame:
    """Messages and estimated cost per tier."""
    t = sessions.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MODEL_TIERS])
    return t.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("messages"),
                 rnd(F.col(m) * F.lit(COST_PER_MESSAGE[m]), 2).alias("cost")) for m in MODEL_TIERS])).alias("x")).select("x.*")


def value_estimate(sessions: DataFrame, *, rate: float = scoring.MONTHLY_RATE) -> DataFrame:
    """Total per-message value and its multiple of one subscription month."""
    value = F.sum("cost")
    return model_message_costs(sessions).agg(
        rnd(value, 2).alias("total_value"), F.sum("messages").alias("total_queries"),
        F.when(value > 0, rnd(value / F.lit(rate), 1)).otherwise(F.lit(0.0)).alias("roi_multiplier"))


def outcome_tally(sessions: DataFrame) -> DataFrame:
    return counter(sessions, "outcome", "outcome")


def outcome_events(sessions: DataFrame) -> DataFrame:
    """Scored sessions as outcome events stamped at the start of their day."""
    ts = F.unix_date(F.col("date").cast("date")).cast("bigint") * 86400
    return sessions.select(ts.alias("timestamp"), "session_id", "outcome", F.col("quality").alias("quality_score"),
                           F.col("model_efficiency").alias("complexity"), F.col("primary_model").alias("model_used"),
                           F.lit(0.0).alias("cost"), F.col("messages").alias("message_count"))
