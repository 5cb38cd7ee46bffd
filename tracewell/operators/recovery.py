"""Self-healing, recovery, error and activity statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.exprs import day_of, hour_of, hour_start, mean, month_day, nonblank, pct, preview, rnd
from tracewell.functions.scoring import effectiveness_band
from tracewell.operators.filters import within_days
from tracewell.operators.ordering import counter, latest, recent_ascending, tail, top, union_events


def _n() -> Column:
    return F.count(F.lit(1))


def _ok() -> Column:
    return F.count_if(F.col("success") == 1)


def _both(heal: DataFrame, rec: DataFrame, last_n: int | None) -> DataFrame:
    """Heal and recovery events in one shape; each source is cut first."""
    return union_events([
        (tail(heal, "timestamp", last_n), {
            "id": "id", "ts": "timestamp", "success": "success", "auto": F.lit(1).cast("bigint"),
            "category": nonblank("error_pattern", default="unknown"),
            "action": nonblank("fix_applied", "error_pattern", default="unknown")}),
        (tail(rec, "timestamp", last_n), {
            "id": "id", "ts": "timestamp", "success": "success", "auto": F.lit(0).cast("bigint"),
            "category": nonblank("error_type", default="unknown"),
            "action": nonblank("recovery_strategy", "error_type", default="unknown")})])


def stats(heal: DataFrame, rec: DataFrame, *, last_n: int | None = None) -> DataFrame:
    """Events, automatic fixes and both rates over the newest events of each source."""
    auto = F.count_if((F.col("auto") == 1) & (F.col("success") == 1))
    return _both(heal, rec, last_n).agg(
        _n().alias("total"), auto.alias("auto_fix"), F.coalesce(pct(auto, _n()), F.lit(0.0)).alias("auto_fix_rate"),
        F.coalesce(pct(_ok(), _n()), F.lit(0.0)).alias("success_rate"))


def by_category(heal: DataFrame, rec: DataFrame, *, last_n: int | None = None) -> DataFrame:
    return _both(heal, rec, last_n).groupBy("category").agg(
        _n().alias("n"), _ok().alias("success"), pct(_ok(), _n()).alias("success_pct"))


def recent_actions(heal: DataFrame, rec: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` of each source, concatenated."""
    return _both(heal, rec, n).select("action", "category", F.coalesce("ts", F.lit(0)).alias("ts"), "success", "auto")


def timeline(heal: DataFrame, *, as_of: int, days: int = 7, last_n: int | None = None) -> DataFrame:
    """Automatic and suggested fixes per day. Whole days elapsed must not exceed ``days``.

    Days are kept as dates and labelled at the end, so a year end sorts right.
    """
    age = F.floor((F.lit(as_of) - F.col("timestamp")) / F.lit(86400))
    recent = tail(heal, "timestamp", last_n).filter(age <= days)
    return recent.groupBy(day_of("timestamp").alias("day")).agg(
        _ok().alias("auto_fix"), F.count_if(F.col("success") == 0).alias("suggested")).orderBy("day").select(
        "day", month_day("day").alias("label"), "auto_fix", "suggested")


def totals_by(rec: DataFrame) -> DataFrame:
    """Recoveries by type and by method, as (dimension, value, n)."""
    kinds = counter(rec, "error_type", "value").select(F.lit("type").alias("dimension"), "value", "n")
    methods = counter(rec, F.coalesce("recovery_method", F.lit("unknown")), "value").select(
        F.lit("method").alias("dimension"), "value", "n")
    return kinds.unionByName(methods)


def totals(rec: DataFrame) -> DataFrame:
    return rec.agg(_n().alias("total"), F.coalesce(F.sum("success"), F.lit(0)).alias("successful"))


def log_stats(log: DataFrame) -> DataFrame:
    return log.agg(_n().alias("total"), _ok().alias("success"), F.count_if(F.col("success") == 0).alias("failed"),
                   F.coalesce(pct(_ok(), _n()), F.lit(0.0)).alias("success_rate"))


def log_patterns(log: DataFrame, n: int = 10) -> DataFrame:
    return counter(log, nonblank("pattern", "category", default="unknown"), "pattern", n)


def effectiveness(log: DataFrame) -> DataFrame:
    """Success rate per action with a band at 80 and 50 percent."""
    rate = pct(_ok(), _n(), 6)
    return log.groupBy(F.coalesce("action", F.lit("unknown")).alias("action")).agg(
        _n().alias("total"), _ok().alias("success"), rnd(rate, 0).alias("rate"), effectiveness_band(rate).alias("band"))


# ---- errors and activity ---------------------------------------------------

def error_types(log: DataFrame, n: int = 10) -> DataFrame:
    return counter(log, nonblank("type", "category", default="unknown"), "type", n)


def error_total(log: DataFrame) -> DataFrame:
    return log.agg(_n().alias("total_errors"))


def first_errors(log: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` errors by time, messages cut to 100 characters."""
    return top(log, n, "ts", "id").select(
        nonblank("type", "category", default="unknown").alias("type"), preview("message", 100).alias("message"), "ts",
        F.coalesce("severity", F.lit("unknown")).alias("severity"))


def activity_by_type(events: DataFrame, *, as_of: int, days: int = 7) -> DataFrame:
    return counter(within_days(events, "timestamp", days, as_of=as_of), "event_type", "event_type")


def activity_top_types(events: DataFrame, n: int = 10) -> DataFrame:
    return counter(events, "event_type", "event_type", n)


def activity_last_days(events: DataFrame, n: int = 30) -> DataFrame:
    daily = events.filter(F.col("timestamp") != 0).groupBy(day_of("timestamp").alias("date")).agg(_n().alias("n"))
    return top(daily, n, "-date")


def activity_hourly(events: DataFrame, *, as_of: int, days: int = 7) -> DataFrame:
    return within_days(events, "timestamp", days, as_of=as_of).groupBy(hour_start("timestamp").alias("hour")).agg(
        _n().alias("event_count")).orderBy(F.col("hour").desc())


# ---- watchdog and healing runs ---------------------------------------------

def log_daily(lines: DataFrame) -> DataFrame:
    """Keyword counts per day over dated log lines."""
    day = F.regexp_extract("line", r"^\[(\d{4}-\d{2}-\d{2})", 1)
    dated = lines.select(day.alias("date"), "line").filter(F.col("date") != "")
    marks = {"down": "DOWN:", "loaded": "LOADED", "healed": "HEALED"}
    return dated.groupBy("date").agg(*[
        F.count_if(F.col("line").contains(m)).alias(n) for n, m in marks.items()]).orderBy("date")


def heals_by_service(lines: DataFrame, prefix: str) -> DataFrame:
    """Reloads per service, its common prefix removed."""
    loaded = lines.filter(F.col("line").contains("LOADED"))
    name = F.replace(F.trim(F.element_at(F.split("line", "LOADED"), -1)), F.lit(prefix), F.lit(""))
    return counter(loaded.filter(name != ""), name, "service", None, "heals")


def heal_daily(runs: DataFrame, tz: str = "UTC") -> DataFrame:
    """Checks and fixes summed per local day."""
    return runs.groupBy(day_of("ts", tz).alias("date")).agg(
        *[F.sum(c).alias(c) for c in ("ok", "warn", "error", "fixed")], _n().alias("runs")).orderBy("date")


def heal_summary(runs: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return runs.agg(_n().alias("total_runs"), z("fixed").alias("total_fixed"),
                    z(F.col("ok") + F.col("warn") + F.col("error")).alias("total_checks"),
                    z("warn").alias("total_warn"), z("error").alias("total_error"))


def healing_kpis(events: DataFrame, *, as_of: int) -> DataFrame:
    """Healing events today and in 24 hours, mean per touched day, reload success.

    Events are first rolled up by (day, action, success); everything but the
    24-hour count comes from those few rows.
    """
    today = F.lit(as_of - as_of % 86400)
    cells = events.groupBy(day_of("ts").alias("_d"), "action", "success").agg(
        _n().alias("_n"), F.count_if(F.col("ts") > as_of - 86400).alias("_24"),
        F.count_if(F.col("ts") >= today).alias("_t"))
    reload_ = F.col("action") == "reload"
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    k = cells.agg(s("_n").alias("total"), s("_t").alias("today"), s("_24").alias("last_24h"),
                  F.count_distinct("_d").alias("_days"),
                  s(F.when(reload_ & (F.col("success") == 1), F.col("_n"))).alias("reload_ok"),
                  s(F.when(reload_, F.col("_n"))).alias("_reloads"))
    return k.select(
        "total", "today", "last_24h", rnd(F.col("total") / F.greatest("_days", F.lit(1)), 1).alias("avg_per_day"),
        "reload_ok", F.coalesce(pct(F.col("reload_ok"), F.col("_reloads"), 0), F.lit(100.0)).alias("reload_success"))


def healing_events(parsed_log: DataFrame, runs: DataFrame) -> DataFrame:
    """Healing events read from the log united with fixes from the run log.

    ``parsed_log`` has (ts text, action, subject); runs that fixed nothing are
    not events.
    """
    from tracewell.functions.exprs import datetime_of
    fixed = runs.filter(F.col("fixed") > 0)
    return union_events([
        (parsed_log, {"timestamp": "ts", "service": "subject", "action": "action",
                      "success": (F.col("action") != "detected").cast("bigint"), "message": "message"}),
        (fixed, {"timestamp": datetime_of("ts"), "service": F.lit("self-heal"), "action": F.lit("deep-heal"),
                 "success": F.lit(1).cast("bigint"),
                 "message": F.concat(F.lit("Deep heal fixed "), F.col("fixed").cast("string"), F.lit(" issue(s)"))})])


def risky_hours(runs: DataFrame, n: int = 3, tz: str = "UTC") -> DataFrame:
    """Hours with most runs that warned or failed."""
    bad = runs.filter((F.col("warn") > 0) | (F.col("error") > 0))
    return top(bad.groupBy(hour_of("ts", tz).alias("hour")).agg(_n().alias("n")), n, "-n", "hour")


def fix_effectiveness(runs: DataFrame) -> DataFrame:
    """Fixes per run that fixed something; above 1 when a run fixes several issues."""
    hit = F.count_if(F.col("fixed") > 0)
    return runs.agg(hit.alias("runs_with_fixes"), F.coalesce(
        F.try_divide(F.sum(F.when(F.col("fixed") > 0, F.col("fixed"))).cast("double"), hit), F.lit(0.0))
        .alias("effectiveness"))


def flow_stats(flow: DataFrame) -> DataFrame:
    return flow.agg(_n().alias("measurements"), F.coalesce(rnd(mean("score"), 3), F.lit(0.0)).alias("avg_flow"))


def flow_peak_hours(flow: DataFrame, n: int = 5, cut: float = 0.5) -> DataFrame:
    hours = flow.filter(F.col("score") > cut).groupBy(hour_of("timestamp").alias("hour")).agg(_n().alias("n"))
    return top(hours, n, "-n", "hour")


def permission_prompts(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("event_type") == "permission_prompt").alias("permission_events"))


def newest_runs(runs: DataFrame, n: int = 100) -> DataFrame:
    return latest(runs, "ts", n)


def recent_daily_heals(runs: DataFrame, n: int = 30) -> DataFrame:
    return recent_ascending(heal_daily(runs), "date", n)


def marker_ratio(lines: DataFrame, token: str) -> DataFrame:
    """Percent of log lines that contain a marker."""
    return lines.agg(_n().alias("lines"), F.coalesce(
        pct(F.count_if(F.col("line").contains(token)), _n()), F.lit(0.0)).alias("marked_pct"))


def array_sizes(documents: DataFrame, **arrays: str) -> DataFrame:
    """Lengths of array fields of state documents, 0 when missing."""
    return documents.select(*[
        F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint").alias(n)
        for n, c in arrays.items()])
