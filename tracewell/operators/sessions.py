"""Sessions and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import scoring
from tracewell.functions.exprs import MODEL_TIERS, day_of, exact_sum, exact_total, mean, minutes_between, pct, preview, rnd
from tracewell.operators.filters import within_days
from tracewell.operators.ordering import top
from tracewell.operators.windows import arg_max

OUTCOMES = ("success", "abandoned", "partial", "error")


def _n() -> Column:
    return F.count(F.lit(1))


def _is(outcome: str) -> Column:
    return F.count_if(F.col("outcome") == outcome)


def longest(sessions: DataFrame) -> DataFrame:
    """Session with the most messages: id preview, start date, messages."""
    best = arg_max(sessions, "message_count", ["id", "started_at", "message_count"], ["id"])
    return best.select(preview("id", 20).alias("session_id"), day_of("started_at").alias("date"), "message_count")


def outcome_counts(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("outcome").isNotNull()).groupBy("outcome").agg(_n().alias("n"))


def outcome_totals(sessions: DataFrame) -> DataFrame:
    """One row of outcome counts. A NULL outcome is not counted as ``other``."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return sessions.filter(F.col("started_at").isNotNull()).agg(
        _n().alias("total"), *[_is(o).alias(o) for o in OUTCOMES],
        F.count_if(~F.col("outcome").isin(*OUTCOMES)).alias("other"),
        F.coalesce(rnd(mean("message_count"), 1), F.lit(0.0)).alias("avg_messages"),
        z("message_count").alias("total_messages"), z("tool_count").alias("total_tools"),
        F.count_if(F.col("message_count") == 0).alias("empty"),
        F.count_if(F.col("message_count") > 100).alias("marathon"))


def quality_hist(outcomes: DataFrame) -> DataFrame:
    """Events per rounded quality score, positive scores only."""
    q = F.floor(F.col("quality_score") + 0.5).cast("bigint")
    return outcomes.filter(F.col("quality_score") > 0).groupBy(q.alias("quality")).agg(_n().alias("n"))


def outcome_by_model(sessions: DataFrame) -> DataFrame:
    """Outcomes per model; an unknown model counts for the default tier."""
    return sessions.filter(F.col("started_at").isNotNull()).groupBy(
        F.coalesce("model", F.lit("opus")).alias("model")).agg(
        _is("success").alias("success"), _is("abandoned").alias("abandoned"), _is("partial").alias("partial"),
        _n().alias("total"), pct(_is("success"), _n()).alias("success_rate"))


def size_buckets(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(scoring.size_bucket("message_count").alias("size")).agg(_n().alias("n"))


def outcome_daily(sessions: DataFrame, outcomes: DataFrame, *, dedupe: bool = False) -> DataFrame:
    """Daily trend over sessions joined to their outcome events.

    Counts follow the joined rows (a session repeats per event) unless
    ``dedupe`` is set. Both forms aggregate the events per session before the
    join: a session with k events has its counters multiplied by max(k, 1),
    which equals the joined rows without ever forming them.
    """
    per = outcomes.groupBy(F.col("session_id").alias("_sid")).agg(
        _n().alias("_k"), exact_total("quality_score").alias("_q"), F.count("quality_score").alias("_qn"))
    s = sessions.filter(F.col("started_at").isNotNull())
    joined = s.join(per, s["id"] == per["_sid"], "left")
    weight = F.lit(1) if dedupe else F.coalesce("_k", F.lit(1))

    def tally(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, weight)), F.lit(0))

    return joined.groupBy(day_of("started_at").alias("date")).agg(
        F.sum(weight).alias("sessions"), tally(F.col("outcome") == "success").alias("success"),
        tally(F.col("outcome") == "abandoned").alias("abandoned"),
        F.coalesce(F.sum(F.col("message_count") * weight), F.lit(0)).alias("messages"),
        F.coalesce(F.try_divide(F.sum("_q").cast("double"), F.sum("_qn")), F.lit(0.0)).alias("avg_quality"),
        *[tally(F.col("model") == m).alias(m) for m in MODEL_TIERS]).orderBy("date")


def daily_success_rate(daily: DataFrame) -> DataFrame:
    rate = F.when(F.col("sessions") > 0, pct(F.col("success"), F.col("sessions"))).otherwise(F.lit(0.0))
    return daily.select("date", rate.alias("success_pct"))


def session_count(outcomes: DataFrame, *, as_of: int, days: int = 7) -> DataFrame:
    return within_days(outcomes, "timestamp", days, as_of=as_of).agg(
        F.count_distinct("session_id").alias("sessions"))


def averages(outcomes: DataFrame, routing: DataFrame, *, as_of: int, days: int = 7) -> DataFrame:
    """Mean quality, DQ and complexity in the window, as (metric, value); NULL when empty."""
    o = within_days(outcomes, "timestamp", days, as_of=as_of).agg(mean("quality_score").alias("value"))
    r = within_days(routing, "timestamp", days, as_of=as_of).agg(
        mean("dq_score").alias("d"), mean("complexity").alias("c"))
    cells = F.explode(F.array(F.struct(F.lit("dq_score").alias("metric"), F.col("d").alias("value")),
                              F.struct(F.lit("complexity").alias("metric"), F.col("c").alias("value"))))
    return o.select(F.lit("quality_score").alias("metric"), "value").unionByName(
        r.select(cells.alias("x")).select("x.*"))


def recent_sessions(sessions: DataFrame, n: int = 100) -> DataFrame:
    """Newest sessions with their duration in minutes (NULL while open)."""
    cut = top(sessions, n, "-started_at", "id")
    return cut.select("id", "project_path", "started_at", "model", "message_count", "outcome", "cost_estimate",
                      minutes_between("started_at", "ended_at").alias("duration_minutes"))


def recent_with_outcomes(sessions: DataFrame, outcomes: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` joined rows, with fallback quality and complexity.

    The cut is on joined rows, so only the newest ``n`` sessions can appear, and they
    are cut first. Whether ``n`` rows are few enough to be broadcast is Spark's choice.
    """
    newest = top(sessions.filter(F.col("started_at").isNotNull()).drop("quality", "complexity"), n,
                 "-started_at", "id")
    events = outcomes.select(F.col("session_id").alias("_sid"), F.col("quality_score").alias("quality"), "complexity")
    matched = events.join(newest, F.col("_sid") == F.col("id")).drop("_sid")
    bare = newest.join(matched.select("id").distinct(), "id", "left_anti")
    joined = matched.unionByName(bare, allowMissingColumns=True)
    row = top(joined, n, "-started_at", "id", "quality", "complexity")
    return row.select(
        F.col("id").alias("session_id"), day_of("started_at").alias("date"),
        F.coalesce("message_count", F.lit(0)).alias("messages"), F.coalesce("tool_count", F.lit(0)).alias("tools"),
        F.coalesce("outcome", F.lit("unknown")).alias("outcome"),
        scoring.fallback_quality("quality", "message_count").cast("double").alias("quality"),
        scoring.fallback_complexity("complexity", "tool_count").cast("double").alias("complexity"),
        F.coalesce("model", F.lit("opus")).alias("model"))


def dashboard_summary(tools: DataFrame, activity: DataFrame, routing: DataFrame, outcomes: DataFrame, *,
                      tools_as_of: int, lines_as_of: int, days: int = 7, line_days: int | None = None) -> DataFrame:
    """Four one-row summaries as (section, metric, value) rows of one frame."""
    from tracewell.operators.daily import metric_rows
    ld = days if line_days is None else line_days
    t = within_days(tools, "timestamp", days, as_of=tools_as_of).agg(
        F.count_distinct("tool_name").alias("unique_tools"), _n().alias("total_tool_calls"),
        F.count_if(F.col("success") == 1).alias("successful_calls"), mean("duration_ms").alias("avg_duration"))
    a = within_days(activity, "timestamp", days, as_of=tools_as_of).agg(
        _n().alias("total_events"), F.count_distinct("event_type").alias("unique_event_types"))
    r = within_days(routing, "timestamp", ld, as_of=lines_as_of).agg(
        _n().alias("total_decisions"), mean("dq_score").alias("avg_dq_score"),
        mean("complexity").alias("avg_complexity"))
    s = within_days(outcomes, "timestamp", ld, as_of=lines_as_of).agg(
        F.count_distinct("session_id").alias("total_sessions"), mean("quality_score").alias("avg_quality"),
        mean("message_count").alias("avg_messages"))
    return metric_rows({"tool_stats": t, "activity_stats": a, "routing_stats": r, "session_stats": s}, {})


def legacy_model_outcomes(sessions: DataFrame) -> DataFrame:
    """Outcome rate per model used, from a map of calls per model."""
    used = sessions.select("outcome", F.explode(F.map_keys("models_used")).alias("model"))
    return used.groupBy("model").agg(_n().alias("total"), _is("success").alias("success"),
                                     pct(_is("success"), _n()).alias("success_rate"))


def success_by(outcomes: DataFrame, hour: Column) -> DataFrame:
    """Success by hour, model and complexity band in one pass (grouping sets)."""
    rows = outcomes.select(
        hour.cast("string").alias("hour"), F.coalesce("model_used", F.lit("unknown")).alias("model"),
        scoring.complexity_band("complexity").alias("band"), (F.col("outcome") == "success").alias("_ok"))
    sets = rows.groupingSets([["hour"], ["model"], ["band"]], "hour", "model", "band").agg(
        F.grouping_id().alias("_g"), F.count_if("_ok").alias("success"), _n().alias("total"))
    dim = F.when(F.col("_g") == 3, F.lit("hour")).when(F.col("_g") == 5, F.lit("model")).otherwise(F.lit("complexity"))
    return sets.select(dim.alias("dimension"), F.coalesce("hour", "model", "band").alias("value"), "success", "total")


def hourly_success(outcomes: DataFrame, hour: Column) -> DataFrame:
    """Runs, successes and quality sum per hour (a missing quality counts 3)."""
    return outcomes.groupBy(hour.alias("hour")).agg(
        _n().alias("total"), _is("success").alias("success"),
        exact_sum(F.coalesce("quality_score", F.lit(3.0))).alias("quality_sum"))


def optimal_hours(hourly: DataFrame, *, min_samples: int = 3, n: int = 5) -> DataFrame:
    """Best hours by 0.6 success rate + 0.4 quality / 5, with enough samples."""
    rate = F.col("success").cast("double") / F.col("total")
    quality = F.col("quality_sum") / F.col("total")
    enough = hourly.filter(F.col("total") >= min_samples)
    scored = enough.select("hour", rnd(rate * 0.6 + quality / 5 * 0.4, 6).alias("score"), rate.alias("success_rate"),
                           quality.alias("avg_quality"), F.col("total").alias("sample_size"))
    from tracewell.operators.windows import rank_top
    return rank_top(scored, "score", n, ["hour"])


def success_probability(cases: DataFrame, patterns: DataFrame, hour: int) -> DataFrame:
    """0.3 hour + 0.4 model + 0.3 complexity rate; a dimension never seen counts 1/2.

    ``patterns`` is the output of :func:`success_by`: at most 24 + models + 2 rows,
    which become one small map computed once.
    """
    rate = F.col("success") / F.greatest("total", F.lit(1))
    entry = F.struct(F.concat_ws("=", "dimension", "value").alias("k"), rate.alias("v"))
    rates = patterns.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()
    keyed = cases.withColumn("_m", rates)

    def factor(dim: str, value: Column) -> Column:
        return F.coalesce(F.col("_m")[F.concat(F.lit(f"{dim}="), value)], F.lit(0.5))

    f = {"hour": factor("hour", F.lit(str(hour))), "model": factor("model", F.coalesce("model", F.lit("unknown"))),
         "complexity": factor("complexity", scoring.complexity_band("complexity"))}
    p = rnd(f["hour"] * 0.3 + f["model"] * 0.4 + f["complexity"] * 0.3, 6)
    return keyed.select(*cases.columns, *[c.alias(f"{n}_factor") for n, c in f.items()],
                      p.alias("success_probability"), scoring.success_advice(p).alias("advice"))
