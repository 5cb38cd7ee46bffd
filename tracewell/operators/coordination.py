"""Commands, agent coordination, registries and repository activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.exprs import alias_of, datetime_of, day_of, exact_sum, mean, nonblank, pct, preview, rnd
from tracewell.operators.filters import within_days
from tracewell.operators.ordering import counter, tail, top

# Command aliases of the model tiers.
COMMAND_ALIASES = {"opus": ("co", "opus"), "sonnet": ("cc", "sonnet"), "haiku": ("cq", "haiku")}
# File types that count as code.
CODE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "sh", "json", "md")


def _n() -> Column:
    return F.count(F.lit(1))


def command_models(commands: DataFrame) -> DataFrame:
    return counter(commands, alias_of("command", COMMAND_ALIASES), "model")


def top_commands(commands: DataFrame, n: int = 15) -> DataFrame:
    agg = commands.filter(F.col("command") != "").groupBy("command").agg(
        _n().alias("n"), rnd(mean("execution_time_ms"), 0).alias("avg_ms"))
    return top(agg, n, "-n", "command")


def command_daily(commands: DataFrame, tz: str = "UTC") -> DataFrame:
    word = F.lower("command")
    return commands.groupBy(day_of("timestamp", tz).alias("day")).agg(
        _n().alias("total"), *[F.count_if(word.isin(*w)).alias(m) for m, w in COMMAND_ALIASES.items()]).orderBy("day")


def command_totals(commands: DataFrame, tz: str = "UTC") -> DataFrame:
    """Commands, distinct commands and active days.

    Both distinct counts come from one rollup by (command, day), which is tiny;
    a direct double ``count(distinct)`` would expand every event twice.
    """
    cells = commands.groupBy("command", day_of("timestamp", tz).alias("_d")).agg(_n().alias("_n"))
    return cells.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_commands"),
                     F.count_distinct("command").alias("unique_commands"),
                     F.count_distinct("_d").alias("active_days"))


def _actions() -> list[Column]:
    return [F.count_if(F.col("action") == "complete").alias("completed"),
            F.count_if(F.col("action") == "fail").alias("failed")]


def by_strategy(events: DataFrame) -> DataFrame:
    """Outcomes per strategy; a blank strategy is called unnamed."""
    return events.groupBy(nonblank("strategy", default="unnamed").alias("strategy")).agg(
        _n().alias("total"), *_actions(), F.count_if(F.col("action") == "timeout").alias("timed_out"),
        rnd(mean("duration_ms"), 0).alias("avg_duration_ms"))


def by_action(events: DataFrame) -> DataFrame:
    return counter(events, "action", "action")


def coordinator_daily(events: DataFrame, tz: str = "UTC") -> DataFrame:
    return events.groupBy(day_of("timestamp", tz).alias("day")).agg(_n().alias("total"), *_actions()).orderBy("day")


def coordinator_recent(events: DataFrame, n: int = 15, tz: str = "UTC") -> DataFrame:
    """Newest events with local time and a preview of the result."""
    return top(events, n, "-timestamp", "-id").select(
        "id", datetime_of("timestamp", tz).alias("time"), "agent_id", "action", "strategy", "duration_ms", "exit_code",
        preview("result", 80).alias("result_preview"))


def coordinator_totals(events: DataFrame) -> DataFrame:
    done = F.count_if(F.col("action") == "complete")
    return events.agg(
        _n().alias("total_events"), F.count_distinct("agent_id").alias("unique_agents"),
        done.alias("total_completed"), F.count_if(F.col("action") == "fail").alias("total_failed"),
        pct(done, F.greatest(_n(), F.lit(1))).alias("success_rate"))


# ---- registries ------------------------------------------------------------

def explode_registry(documents: DataFrame, col: str, key: str) -> DataFrame:
    """Entries of a map document {id: struct} as rows (id plus struct fields)."""
    return documents.select(F.explode(col).alias(key, "_v")).select(key, "_v.*")


def explode_locks(documents: DataFrame, col: str) -> DataFrame:
    """Locks of a {path: [lock, ..]} document as rows (path plus lock fields)."""
    per_path = documents.select(F.explode(col).alias("path", "_l"))
    return per_path.select("path", F.explode_outer("_l").alias("_l")).select("path", "_l.*")


def agent_registry(agents: DataFrame) -> DataFrame:
    """Agents by state and by model, as (dimension, value, agents)."""
    parts = [counter(agents, F.coalesce(c, F.lit("unknown")), "value", None, "agents")
             .select(F.lit(c).alias("dimension"), "value", "agents") for c in ("state", "model")]
    return parts[0].unionByName(parts[1])


def agent_totals(agents: DataFrame) -> DataFrame:
    active = F.coalesce(F.col("state").isin("pending", "running"), F.lit(False))
    return agents.agg(_n().alias("total_agents"), F.count_if(active).alias("active"),
                      F.coalesce(exact_sum("cost_estimate"), F.lit(0.0)).alias("total_cost"))


def lock_totals(locks: DataFrame) -> DataFrame:
    """Locks, reads, writes (the remainder), files and distinct holders."""
    held = F.count("lock_type")
    reads = F.count_if(F.col("lock_type") == "read")
    cells = locks.groupBy("path", "agent_id").agg(held.alias("_h"), reads.alias("_r"))
    return cells.agg(
        F.coalesce(F.sum("_h"), F.lit(0)).alias("total_locks"), F.coalesce(F.sum("_r"), F.lit(0)).alias("read_locks"),
        F.coalesce(F.sum("_h") - F.sum("_r"), F.lit(0)).alias("write_locks"),
        F.count_distinct("path").alias("files_locked"), F.count_distinct("agent_id").alias("agents_with_locks"))


# ---- repositories ----------------------------------------------------------

def git_stats(git: DataFrame, *, as_of: int, last_n: int | None = None) -> DataFrame:
    """Counts and line changes over the newest ``last_n`` events (the cut comes first)."""
    recent = tail(git, "timestamp", last_n)
    today = as_of - as_of % 86400
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return recent.agg(
        _n().alias("total"), F.count_if(F.col("timestamp") >= today).alias("today"),
        F.count_if(F.col("timestamp") >= as_of - 7 * 86400).alias("week"),
        z("additions").alias("insertions"), z("deletions").alias("deletions"))


def git_by_repo(git: DataFrame, last_n: int | None = None) -> DataFrame:
    return counter(tail(git, "timestamp", last_n), F.coalesce("repo", F.lit("unknown")), "repo")


def git_daily(git: DataFrame, *, as_of: int, days: int = 30, n: int = 30) -> DataFrame:
    daily = within_days(git, "timestamp", days, as_of=as_of).groupBy(day_of("timestamp").alias("date")).agg(
        _n().alias("commits"))
    return top(daily, n, "-date")


def top_authors(git: DataFrame, n: int = 5) -> DataFrame:
    return counter(git.filter(F.col("author").isNotNull()), "author", "author", n, "commits")


def most_changed(changes: DataFrame, n: int = 15) -> DataFrame:
    """Most changed code files: paths with a directory and a code extension."""
    file = F.col("file")
    ext = F.element_at(F.split(file, r"\."), -1)
    code = changes.filter(file.contains(".") & file.contains("/") & ext.isin(*CODE_EXTENSIONS))
    return top(code.groupBy("project", "file").agg(_n().alias("n")), n, "-n", "project", "file")
