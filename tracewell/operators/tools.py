"""Tool usage, success and failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.exprs import day_of, hour_of, mean, pct, rnd, zero_if_null
from tracewell.functions.scoring import read_write_mode, write_mode
from tracewell.operators.filters import not_before, within_days
from tracewell.operators.joins import calendar_fill
from tracewell.operators.ordering import counter, top

# The tool kinds the panels count one by one, and the categories.
KINDS = {"writes": "Write", "edits": "Edit", "bash": "Bash", "reads": "Read"}
CORE_TOOLS = ("Bash", "Read", "Edit", "Write")
SEARCH_TOOLS = ("Grep", "Glob")


def _ok() -> Column:
    return F.count_if(F.col("success") == 1)


def _failed() -> Column:
    return F.count_if(F.col("success") == 0)


def _n() -> Column:
    return F.count(F.lit(1))


def usage_summary(events: DataFrame, *, as_of: int, days: int = 7) -> DataFrame:
    """Calls, successes, failures, mean duration, last use and success rate per tool."""
    return within_days(events, "timestamp", days, as_of=as_of).groupBy("tool_name").agg(
        _n().alias("total_calls"), _ok().alias("success_count"), _failed().alias("failure_count"),
        mean("duration_ms").alias("avg_duration_ms"), F.max("timestamp").alias("last_used"),
        pct(_ok(), _n()).alias("success_rate")).orderBy(F.col("total_calls").desc(), "tool_name")


def success_rate(events: DataFrame, *, as_of: int, days: int = 7, min_calls: int = 5, n: int = 10) -> DataFrame:
    """Tools with more than ``min_calls`` calls, worst first."""
    rates = within_days(events, "timestamp", days, as_of=as_of).groupBy("tool_name").agg(
        _n().alias("total"), pct(_ok(), _n()).alias("success_rate"))
    return top(rates.filter(F.col("total") > min_calls), n, "success_rate", "tool_name")


def hourly_calls(events: DataFrame, *, as_of: int, days: int = 7, tz: str = "UTC") -> DataFrame:
    return within_days(events, "timestamp", days, as_of=as_of).groupBy(
        hour_of("timestamp", tz).alias("hour")).agg(_n().alias("calls")).orderBy("hour")


def totals(events: DataFrame, *, as_of: int, days: int = 7, approximate: bool = False) -> DataFrame:
    """Events, distinct tools, success percentage and mean duration."""
    uniq = F.approx_count_distinct("tool_name") if approximate else F.count_distinct("tool_name")
    return within_days(events, "timestamp", days, as_of=as_of).agg(
        _n().alias("total_events"), uniq.alias("unique_tools"), pct(_ok(), _n()).alias("overall_success_rate"),
        rnd(mean("duration_ms"), 1).alias("avg_duration"))


def kind_totals(events: DataFrame) -> DataFrame:
    return events.agg(_n().alias("total"), *[F.count_if(F.col("tool_name") == t).alias(k) for k, t in KINDS.items()])


def calls_by_tool(events: DataFrame, n: int | None = None) -> DataFrame:
    return counter(events, "tool_name", "tool_name", n, "calls")


def daily_kinds(events: DataFrame, *, since: int, end: str | None = None) -> DataFrame:
    """Counts by kind per day from the first plausible event, missing days as 0."""
    daily = not_before(events, "timestamp", since).groupBy(day_of("timestamp").alias("date")).agg(
        _n().alias("total"), *[F.count_if(F.col("tool_name") == t).alias(k) for k, t in KINDS.items()])
    return calendar_fill(daily, "date", ["total", *KINDS], end=end)


def overview(events: DataFrame) -> DataFrame:
    """Total calls, failures, and the rate, which is 100 on an empty log."""
    return events.agg(
        _n().alias("total"), _failed().alias("failures"),
        F.coalesce(pct(_ok(), _n()), F.lit(100.0)).alias("success_rate"))


def failure_patterns(events: DataFrame, *, as_of: int, days: int = 30, n: int = 20) -> DataFrame:
    """Failures per tool and day with one sample message (the smallest)."""
    failed = within_days(events, "timestamp", days, as_of=as_of).filter(F.col("success") == 0)
    # A text minimum cannot be kept in a hash aggregate, so equal messages are counted first.
    cells = failed.groupBy("tool_name", day_of("timestamp").alias("date"), "error_message").agg(_n().alias("_n"))
    agg = cells.groupBy("tool_name", "date").agg(
        F.sum("_n").alias("failures"), F.coalesce(F.min("error_message"), F.lit("Unknown error")).alias("error"))
    return top(agg, n, "-failures", "-date", "tool_name")


def log_success(log: DataFrame, n: int = 20) -> DataFrame:
    """Success per tool from the tool log, by volume; blank names count as unknown."""
    agg = log.groupBy(F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(
        _n().alias("total"), pct(_ok(), _n()).alias("rate"))
    return top(agg, n, "-total", "tool")


def log_success_overall(log: DataFrame) -> DataFrame:
    return log.agg(_n().alias("total"), _ok().alias("success"),
                   F.coalesce(pct(_ok(), _n()), F.lit(0.0)).alias("overall_success_rate"))


def log_usage(log: DataFrame, n: int = 20) -> DataFrame:
    """Calls by tool (top ``n``) and by model, as (dimension, value, calls)."""
    tools = counter(log, F.coalesce("tool", F.lit("unknown")), "value", n, "calls")
    models = counter(log, F.coalesce("model", F.lit("unknown")), "value", None, "calls")
    return tools.select(F.lit("tool").alias("dimension"), "value", "calls").unionByName(
        models.select(F.lit("model").alias("dimension"), "value", "calls"))


def category_mix(events: DataFrame) -> DataFrame:
    """Core, search and advanced calls; advanced is what remains, never below 0."""
    t = events.agg(_n().alias("_n"), F.count_if(F.col("tool_name").isin(*CORE_TOOLS)).alias("_core"),
                   F.count_if(F.col("tool_name").isin(*SEARCH_TOOLS)).alias("_search"))
    rest = F.greatest(F.lit(0), F.col("_n") - F.col("_core") - F.col("_search"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("category"), c.alias("calls")) for n, c in (
        ("core", F.col("_core")), ("search", F.col("_search")), ("advanced", rest))]))
    return t.select("_n", rows.alias("r")).select(
        "r.category", "r.calls", F.coalesce(pct(F.col("r.calls"), F.col("_n")), F.lit(0.0)).alias("pct"))


def unweighted_success(events: DataFrame) -> DataFrame:
    """Mean of the per-tool rates, each tool counting once; 100 without tools."""
    rates = events.groupBy("tool_name").agg(pct(_ok(), _n()).alias("r"))
    return rates.agg(F.coalesce(mean("r"), F.lit(100.0)).alias("success_rate"))


def per_active_day(daily: DataFrame, col: str) -> DataFrame:
    """Total, active days and mean per active day."""
    active = F.count_if(F.col(col) > 0)
    return daily.agg(F.coalesce(F.sum(col), F.lit(0)).alias("total"), active.alias("active_days"),
                     F.coalesce(rnd(F.try_divide(F.sum(col), active), 0), F.lit(0.0)).alias("avg_daily"))


def command_weights(log: DataFrame, n: int = 15) -> DataFrame:
    """Commands weighted by their ``count`` field (1 when absent)."""
    weight = F.coalesce("count", F.lit(1))
    cmd = F.coalesce(F.nullif(F.col("cmd"), F.lit("")), "command", F.lit("unknown"))
    return top(log.groupBy(cmd.alias("command")).agg(F.sum(weight).alias("uses")), n, "-uses", "command")


def tool_summary(events: DataFrame, n: int = 20) -> DataFrame:
    """Top tools with the total and the number of distinct tools beside them."""
    counts = events.groupBy("tool_name").agg(_n().alias("calls"))
    whole = lambda c: counts.agg(c.alias("v")).scalar()
    return top(counts, n, "-calls", "tool_name").withColumns({
        "total_calls": whole(F.sum("calls")), "unique_tools": whole(F.count(F.lit(1)))})


def productivity(events: DataFrame) -> DataFrame:
    """Share of writes in file operations and the two mode labels."""
    t = kind_totals(events)
    writes = F.col("edits") + F.col("writes")
    share = F.coalesce(F.try_divide(writes.cast("double"), (F.col("reads") + writes).cast("double")), F.lit(0.0))
    return t.select("total", "reads", writes.alias("write_ops"), share.alias("write_share"),
                    write_mode(share).alias("mode"), read_write_mode(F.col("reads"), writes).alias("ratio_mode"),
                    F.coalesce(pct(writes, F.col("total")), F.lit(0.0)).alias("write_intensity"))


def daily_productivity(daily: DataFrame) -> DataFrame:
    """Write share per day, NULL on days without file operations."""
    writes = F.col("edits") + F.col("writes")
    return daily.select("date", F.try_divide(writes.cast("double"), (F.col("reads") + writes).cast("double"))
                        .alias("score"))


def weighted_success(counts: DataFrame) -> DataFrame:
    """Rate from the counter table (tool_name, success_count, failure_count)."""
    ok, bad = F.sum(zero_if_null("success_count")), F.sum(zero_if_null("failure_count"))
    return counts.agg(pct(ok, ok + bad).alias("success_rate"))
