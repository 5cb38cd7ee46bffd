"""Daily and hourly rollups: totals, tokens, cost views, cost trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.exprs import MODEL_TIERS, exact_sum, pct, rnd
from tracewell.functions.scoring import MONTHLY_RATE, PRICES, VIEW_PRICES, token_cost
from tracewell.operators.windows import last_rows_sum


def _messages(tiers: Sequence[str] = MODEL_TIERS) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"{m}_messages") for m in tiers])


def _all(measure: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"{m}_{measure}") for m in MODEL_TIERS])


def to_long(daily: DataFrame) -> DataFrame:
    """The wide daily table as (date, model, messages, tokens_in, tokens_out, cache_read)."""
    rows = [F.struct(F.lit(m).alias("model"), *[
        F.coalesce(f"{m}_{x}", F.lit(0)).alias(x) for x in ("messages", "tokens_in", "tokens_out", "cache_read")])
        for m in MODEL_TIERS]
    return daily.select("date", F.explode(F.array(*rows)).alias("r")).select("date", "r.*")


def totals(daily: DataFrame) -> DataFrame:
    """All-time messages, sessions, tools, per-model messages and cost, in one row."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return daily.agg(
        z(_messages()).alias("total_messages"), z("session_count").alias("total_sessions"),
        z("tool_calls").alias("total_tools"),
        *[z(f"{m}_messages").alias(f"{m}_messages") for m in MODEL_TIERS],
        F.coalesce(exact_sum("cost_estimate"), F.lit(0.0)).alias("total_cost"))


def by_model_tokens(daily_long: DataFrame) -> DataFrame:
    return daily_long.groupBy("model").agg(*[
        F.sum(c).alias(c) for c in ("messages", "tokens_in", "tokens_out", "cache_read")])


def hour_pattern(hourly: DataFrame, *, include_messages: bool = False) -> DataFrame:
    measure = F.col("session_count") + F.col("message_count") if include_messages else F.col("session_count")
    return hourly.groupBy("hour").agg(F.sum(measure).alias("total")).orderBy("hour")


def daily_series(daily: DataFrame) -> DataFrame:
    return daily.select("date", _messages().alias("message_count"), "session_count", "tool_calls").orderBy("date")


def daily_tokens(daily: DataFrame) -> DataFrame:
    """Token total per model and day, with the parts it is made of."""
    parts = ("tokens_in", "tokens_out", "cache_read")
    return daily.select(
        "date",
        *[reduce(lambda a, b: a + b, [F.col(f"{m}_{p}") for p in parts]).alias(f"{m}_total") for m in MODEL_TIERS],
        *[F.coalesce(f"{m}_{p}", F.lit(0)).alias(f"{m}_{p}") for m in MODEL_TIERS for p in parts]).orderBy("date")


def recent_daily(daily: DataFrame, days: int = 30, *, as_of: str) -> DataFrame:
    from tracewell.operators.filters import within_dates
    return within_dates(daily, "date", days, as_of=as_of).orderBy(F.col("date").desc())


def model_tokens(sessions: DataFrame, day: Column) -> DataFrame:
    """Tokens per day and tier, tiers read from the model name."""
    from tracewell.functions.exprs import tier_of
    rows = sessions.filter(F.col("started_at").isNotNull())
    return rows.groupBy(day.alias("date"), tier_of("model").alias("model")).agg(
        F.sum("message_count").alias("messages"), F.sum("input_tokens").alias("tokens_in"),
        F.sum("output_tokens").alias("tokens_out"), F.sum("cache_read_tokens").alias("cache_read"))


def to_daily_stats(activity: DataFrame, tokens: DataFrame, model_counts: DataFrame) -> DataFrame:
    """Daily activity joined with tokens per model, as the wide daily table.

    A day without token rows gives its messages to the model used most.
    ``model_counts`` is (model, n) with a row per tier.
    """
    wide = tokens.groupBy("date").agg(*[
        F.coalesce(F.sum(F.when(F.col("model") == m, F.col(x))), F.lit(0)).alias(f"{m}_{x}")
        for m in MODEL_TIERS for x in ("messages", "tokens_in", "tokens_out", "cache_read")])
    def uses(m: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("model") == m, F.col("n"))), F.lit(0))

    opus_leads = model_counts.agg((uses("opus") > uses("sonnet")).alias("v")).scalar()
    joined = activity.join(wide, "date", "left")
    known = F.col("opus_messages").isNotNull()
    fill = {
        "opus_messages": F.when(known, F.col("opus_messages")).when(opus_leads, F.col("messages")).otherwise(F.lit(0)),
        "sonnet_messages": F.when(known, F.col("sonnet_messages")).when(~opus_leads, F.col("messages"))
        .otherwise(F.lit(0))}
    cols = [fill.get(f"{m}_{x}", F.coalesce(f"{m}_{x}", F.lit(0))).alias(f"{m}_{x}")
            for m in MODEL_TIERS for x in ("messages", "tokens_in", "tokens_out", "cache_read")]
    out = joined.select("date", *cols, F.col("sessions").alias("session_count"), F.col("tools").alias("tool_calls"))
    return out.withColumn("cost_estimate", day_cost())


def day_cost(prices: Mapping[str, Mapping[str, float]] = PRICES) -> Column:
    """Token cost of a wide daily row."""
    return reduce(lambda a, b: a + b, [
        token_cost(F.lit(m), f"{m}_tokens_in", f"{m}_tokens_out", f"{m}_cache_read", prices) for m in MODEL_TIERS])


def activity_timeline(daily: DataFrame, commits: DataFrame) -> DataFrame:
    """Tools, sessions, messages and commits per day, newest first. ``commits`` is (date, commits)."""
    return daily.join(commits, "date", "left").select(
        "date", F.col("tool_calls").alias("tools"), F.col("session_count").alias("sessions"),
        _messages().alias("messages"), F.coalesce("commits", F.lit(0)).alias("commits")).orderBy(F.col("date").desc())


# ---- views -----------------------------------------------------------------

def view_daily_costs(daily: DataFrame) -> DataFrame:
    """Cost per day at the stored view's own prices and flat cache saving."""
    cost = reduce(lambda a, b: a + b, [
        F.col(f"{m}_tokens_in") * VIEW_PRICES[m]["input"] / 1e6 + F.col(f"{m}_tokens_out") * VIEW_PRICES[m]["output"]
        / 1e6 for m in MODEL_TIERS])
    return daily.select("date", rnd(cost, 6).alias("api_cost"), rnd(_all("cache_read") * 0.5 / 1e6, 6)
                        .alias("cache_savings"), _messages().alias("total_messages"), "session_count")


def view_model_distribution(daily: DataFrame) -> DataFrame:
    t = daily.agg(*[F.sum(f"{m}_messages").alias(f"{m}_total") for m in MODEL_TIERS],
                  F.sum(_messages()).alias("grand_total"))
    return t.select("*", *[pct(F.col(f"{m}_total"), F.col("grand_total")).alias(f"{m}_pct") for m in MODEL_TIERS])


def view_token_totals(daily: DataFrame) -> DataFrame:
    t = daily.agg(F.sum(_all("cache_read")).alias("total_cache_read"), F.sum(_all("tokens_in")).alias("total_input"),
                  F.sum(_all("tokens_out")).alias("_out"))
    everything = F.col("total_cache_read") + F.col("total_input") + F.col("_out")
    return t.select("total_cache_read", "total_input", F.when(
        everything > 0, pct(F.col("total_cache_read"), everything)).otherwise(F.lit(0.0)).alias("cache_efficiency"))


def view_subscription(daily: DataFrame, *, as_of: str, rate: float = MONTHLY_RATE) -> DataFrame:
    t = daily.agg(F.sum(_messages()).alias("total_messages"), F.sum("session_count").alias("total_sessions"),
                  exact_sum("cost_estimate").alias("total_value"), F.min("date").alias("_first"))
    months = F.datediff(F.lit(as_of).cast("date"), F.col("_first").cast("date")) / F.lit(30.0)
    roi = F.col("total_value") / (F.greatest(F.lit(1.0), months) * rate)
    return t.select("total_messages", "total_sessions", "total_value", rnd(roi, 1).alias("roi_multiplier"))


# ---- cost ------------------------------------------------------------------

def model_costs(daily_long: DataFrame, prices: Mapping[str, Mapping[str, float]] = PRICES) -> DataFrame:
    """Token cost and cache saving per model.

    Tokens are summed first and priced once per model. ``cache_saving`` is the
    gap between the input price and the cache price.
    """
    t = by_model_tokens(daily_long)
    saving_prices = {m: {"cache": p["input"] - p["cache"]} for m, p in prices.items()}
    return t.select(
        "model", "messages", "tokens_in", "tokens_out", "cache_read",
        rnd(token_cost("model", "tokens_in", "tokens_out", "cache_read", prices), 6).alias("cost"),
        rnd(token_cost("model", F.lit(0), F.lit(0), "cache_read", saving_prices), 6).alias("cache_saving"))


def _cost_totals(daily: DataFrame, prices: Mapping[str, Mapping[str, float]]) -> DataFrame:
    sums = daily.agg(
        *[F.coalesce(F.sum(f"{m}_{x}"), F.lit(0)).alias(f"{m}_{x}") for m in MODEL_TIERS
          for x in ("messages", "tokens_in", "tokens_out", "cache_read")],
        F.min("date").alias("first_date"), F.count(F.lit(1)).alias("n_days"))
    return sums.withColumns({"total_value": rnd(day_cost(prices), 6), "total_messages": _messages()})


#: How each panel turns active time into subscription months paid.
ROI_VARIANTS = ("calendar", "active_rows", "day_rate", "one_month")


def roi(daily: DataFrame, variant: str, *, as_of: str, rate: float = MONTHLY_RATE,
        prices: Mapping[str, Mapping[str, float]] = PRICES) -> DataFrame:
    """Return on the subscription under one of :data:`ROI_VARIANTS`.

    ``calendar``: months since the first day, at least one. ``active_rows``:
    rows / 30, at least one. ``day_rate``: rows x rate / 30 without a minimum of
    one month. ``one_month``: a single month. The stored view's own variant is
    :func:`view_subscription`.
    """
    t = _cost_totals(daily, prices)
    if variant == "calendar":
        days = F.datediff(F.lit(as_of).cast("date"), F.col("first_date").cast("date"))
        months = F.greatest(F.when(days == 0, F.lit(1)).otherwise(F.coalesce(days, F.lit(1))) / F.lit(30.0), F.lit(1.0))
    elif variant == "active_rows":
        months = F.greatest(F.greatest("n_days", F.lit(1)) / F.lit(30.0), F.lit(1.0))
    elif variant == "day_rate":
        months = F.greatest(F.col("n_days") * F.lit(rate / 30.0), F.lit(1.0)) / F.lit(rate)
    elif variant == "one_month":
        months = F.lit(1.0)
    else:
        raise ValueError(f"unknown ROI variant: {variant}")
    paid = months * F.lit(rate)
    return t.select(
        F.lit(variant).alias("variant"), rnd("total_value", 2).alias("total_value"), rnd(paid, 2).alias("paid"),
        rnd(F.col("total_value") / paid, 1).alias("multiplier"),
        rnd(F.col("total_value") - paid, 2).alias("savings"), rnd(months, 1).alias("months"),
        F.when(F.col("total_messages") > 100, F.lit("high")).otherwise(F.lit("normal")).alias("utilization"),
        rnd(F.col("total_value") / F.greatest("total_messages", F.lit(1)), 4).alias("cost_per_message"))


def cache_savings(daily: DataFrame, prices: Mapping[str, Mapping[str, float]] = PRICES,
                  *, rate: float = MONTHLY_RATE) -> DataFrame:
    """Cache efficiency and the three definitions of what the cache saved."""
    t = _cost_totals(daily, prices)
    cache, tin = _all("cache_read"), _all("tokens_in")
    paid = F.greatest(F.greatest("n_days", F.lit(1)) / F.lit(30.0), F.lit(1.0)) * rate
    gap = reduce(lambda a, b: a + b, [
        F.col(f"{m}_cache_read") * F.lit(prices[m]["input"] - prices[m]["cache"]) for m in MODEL_TIERS]) / 1e6
    return t.select(
        rnd(cache / F.greatest(cache + tin, F.lit(1)) * 100, 1).alias("efficiency"),
        rnd(cache * 0.5 / 1e6, 2).alias("flat_saving"),
        F.when(F.col("total_value") > paid, rnd(F.col("total_value") - paid, 2)).otherwise(F.lit(0.0))
        .alias("value_above_subscription"), rnd(gap, 2).alias("price_gap_saving"))


def cost_daily(daily: DataFrame, prices: Mapping[str, Mapping[str, float]] = PRICES) -> DataFrame:
    return daily.select("date", rnd(day_cost(prices), 2).alias("cost"))


def cost_windows(daily: DataFrame, prices: Mapping[str, Mapping[str, float]] = PRICES) -> DataFrame:
    """Latest day, last 7 rows, last 30 rows."""
    w = last_rows_sum(cost_daily(daily, prices), "date", "cost", (1, 7, 30))
    return w.select(*[rnd(f"last_{k}", 2).alias(n) for k, n in ((1, "today"), (7, "week"), (30, "month"))])


def cumulative_roi(daily: DataFrame, *, rate: float = MONTHLY_RATE) -> DataFrame:
    """Running API value against running subscription cost."""
    from tracewell.operators.windows import cumulative
    run = cumulative(daily.select("date", day_cost().alias("_c")), "date", {"_c": "_api"})
    return run.select("date", rnd("_api", 0).alias("api"), rnd(F.col("row") * F.lit(rate / 30.0), 0).alias("sub"))


def stats_bundle(daily: DataFrame, hourly: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """Named frames that together make the statistics panel."""
    from tracewell.operators.sessions import longest
    return {"totals": totals(daily), "model_usage": by_model_tokens(to_long(daily)),
            "hour_counts": hour_pattern(hourly, include_messages=True), "daily_activity": daily_series(daily),
            "daily_model_tokens": daily_tokens(daily), "longest_session": longest(sessions)}


def metric_rows(bundle: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """A bundle as one long frame (section, key, metric, value).

    One-row and keyed panels are unioned, never cross joined, so a panel set is a
    single job. ``keys`` names the key column of each keyed section.
    """
    parts = []
    for section, df in bundle.items():
        key = keys.get(section)
        measures = [c for c, t in df.dtypes if c != key and t in ("bigint", "double", "int")]
        cells = F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in measures]))
        name = F.col(key).cast("string") if key else F.lit("")
        parts.append(df.select(F.lit(section).alias("section"), name.alias("key"), cells.alias("m"))
                     .select("section", "key", "m.metric", "m.value"))
    return reduce(DataFrame.unionByName, parts)
