"""The telemetry store: logging batches in, reading panels out.

Entity and counter tables are :class:`~tracewell.sinks.batches.BatchTable` (batches
merged when read), event tables are append-only Parquet. Every write takes a
DataFrame, so one call logs one row or a billion alike, and costs what the batch
costs, not what the table holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.exprs import day_of
from tracewell.operators import daily, filters, recovery, routing, sessions, streaks
from tracewell.operators.ordering import top
from tracewell.schemas import SCHEMAS
from tracewell.session import checkpointed
from tracewell.sinks import upserts
from tracewell.sinks.batches import BatchTable, clock
from tracewell.sinks.panels import append_rows
from tracewell.sources.tables import read_table

#: Tables changed by key; all others only grow.
KEYED = {"sessions": ["id"], "daily_stats": ["date"], "routing_decisions": ["id"], "tool_usage": ["tool_name"],
         "hourly_activity": ["date", "hour"], "autonomy_streaks": ["start_ts"]}
#: Columns that batches add to, and columns that keep their maximum.
COUNTERS = {"tool_usage": {"add": ["total_calls", "success_count", "failure_count"], "latest": ["last_used"]},
            "hourly_activity": {"add": ["session_count", "message_count"]}}
#: Partition column of event tables, and its value for rows without a time: later than any day,
#: so a bound on the day leaves those rows to the filter on the time itself.
DAY, NO_DAY = "event_date", "unknown"

Metric = Callable[..., DataFrame]


class TelemetryStore:
    """Tables under one root directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._metrics: dict[str, tuple[Metric, str]] = {}
        self._keyed = {n: BatchTable(spark, f"{root}/{n}", SCHEMAS[n], keys, **COUNTERS.get(n, {})) for n, keys in KEYED.items()}

    def table(self, name: str, since: int | None = None) -> DataFrame:
        """A table by name. Event tables lie in folders by day (UTC): ``since``, in epoch seconds, leaves out the days before."""
        if name in self._keyed:
            return self._keyed[name].read()
        days = T.StructType([*SCHEMAS[name].fields, T.StructField(DAY, T.StringType())])
        rows = read_table(self.spark, f"{self.root}/{name}", days)
        if since is not None:
            rows = rows.filter(F.col(DAY) >= day_of(F.lit(since)))
        return rows.select(*SCHEMAS[name].names)

    # ---- writes ----------------------------------------------------------
    def append(self, name: str, rows: DataFrame) -> None:
        """Append events to the folders of their days; columns the batch lacks become NULL."""
        schema = SCHEMAS[name]
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema.fields]
        out = rows.select(*cols)
        day = day_of("timestamp") if "timestamp" in schema.names else F.lit(None).cast("string")
        append_rows(out.withColumn(DAY, F.coalesce(day, F.lit(NO_DAY))), f"{self.root}/{name}", partition_by=DAY)

    def log_sessions(self, rows: DataFrame, source: str = "direct", number: int | None = None, order: tuple[str, ...] = ()) -> int:
        """Replace sessions by id. A batch with several rows for an id needs ``order``, columns whose last value wins.

        ``source`` and ``number`` name the batch, here and below: given again, it replaces itself. See
        :meth:`~tracewell.sinks.batches.BatchTable.write`.
        """
        return self._keyed["sessions"].write(rows, source, number, order)

    def update_daily_stats(self, rows: DataFrame, source: str = "direct", number: int | None = None, order: tuple[str, ...] = ()) -> int:
        return self._keyed["daily_stats"].write(rows, source, number, order)

    def log_routing_decisions(self, rows: DataFrame, source: str = "direct", number: int | None = None, order: tuple[str, ...] = ()) -> int:
        return self._keyed["routing_decisions"].write(rows, source, number, order)

    def record_routing_feedback(self, feedback: DataFrame, source: str = "direct", number: int | None = None) -> int:
        """Rate the newest unrated decision of each query hash; ``feedback`` is (query_hash, verdict).

        Only the decisions rated are written. They are chosen from what the batches before
        this one made, so the batch given again rates the same ones.
        """
        decisions = self._keyed["routing_decisions"]
        number = clock() if number is None else number
        return decisions.write(upserts.rated_rows(decisions.read(below=number), feedback), source, number)

    def update_tool_usage(self, calls: DataFrame, source: str = "direct", number: int | None = None) -> int:
        """Add tool calls (tool_name, success, timestamp, optional calls) to the counters."""
        return self._keyed["tool_usage"].write(upserts.tool_usage_delta(calls), source, number)

    def update_hourly_activity(self, delta: DataFrame, source: str = "direct", number: int | None = None) -> int:
        """Add (date, hour, session_count, message_count) to the hourly counters."""
        return self._keyed["hourly_activity"].write(delta, source, number)

    def rebuild_streaks(self, *, gap_s: int = streaks.GAP_SECONDS, min_s: int = streaks.MIN_SECONDS) -> int:
        """Replace the whole derived streak table."""
        return self._keyed["autonomy_streaks"].replace_all(streaks.autonomy_streaks(
            self.table("tool_events"), self.table("sessions"), gap_s=gap_s, min_s=min_s, materialize=checkpointed))

    def fold(self, below: int) -> None:
        """Merge the batches of all keyed tables below a number, a clock number some time past; to be run now and then."""
        for table in self._keyed.values():
            table.fold(below)

    # ---- metrics of one's own --------------------------------------------
    def register_metric(self, name: str, metric: Metric, key: str) -> None:
        """Add a panel: ``metric(store, as_of=.., day=..)`` gives its frame, with one row for each value of ``key``.

        It is part of :meth:`panels`, and so of every export, and of :meth:`live_metrics`.
        """
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"letters, digits and underscores only: {name!r}")
        if name in self._metrics:
            raise ValueError(f"there is a metric {name!r}")
        self._metrics[name] = (metric, key)

    def live_metrics(self, when: Callable[[], tuple[int, str]]) -> dict[str, tuple[Callable[[DataFrame], DataFrame], str]]:
        """The registered metrics as panels of :func:`~tracewell.streaming.live.publish_changes`; ``when`` gives
        (as_of, day) for each batch."""
        def panel(metric: Metric) -> Callable[[DataFrame], DataFrame]:
            def run(_batch: DataFrame) -> DataFrame:
                as_of, day = when()
                return metric(self, as_of=as_of, day=day)
            return run
        return {name: (panel(metric), key) for name, (metric, key) in self._metrics.items()}

    # ---- reads -----------------------------------------------------------
    def get_sessions(self, days: int = 30, project: str | None = None, *, as_of: int) -> DataFrame:
        return filters.sessions_since(self.table("sessions"), days, as_of=as_of, project=project)

    def get_session_outcomes(self) -> DataFrame:
        return sessions.outcome_counts(self.table("sessions"))

    def get_daily_stats(self, days: int = 30, *, as_of: str) -> DataFrame:
        return daily.recent_daily(self.table("daily_stats"), days, as_of=as_of)

    def get_totals(self) -> DataFrame:
        return daily.totals(self.table("daily_stats"))

    def get_routing_stats(self, days: int = 7, *, as_of: int) -> DataFrame:
        return routing.stats(self.table("routing_decisions"), as_of=as_of, days=days)

    def get_tool_stats(self, limit: int = 20) -> DataFrame:
        return top(self.table("tool_usage"), limit, "-total_calls", "tool_name")

    def get_hourly_pattern(self) -> DataFrame:
        return daily.hour_pattern(self.table("hourly_activity"))

    def export_stats(self) -> dict[str, DataFrame]:
        return daily.stats_bundle(self.table("daily_stats"), self.table("hourly_activity"), self.table("sessions"))

    def panels(self, *, as_of: int, day: str) -> dict[str, DataFrame]:
        """All panel frames, ready for :func:`tracewell.sinks.panels.export_panels`. They describe all stored events."""
        d, s, o = self.table("daily_stats"), self.table("sessions"), self.table("session_outcome_events")
        r, heal, rec = self.table("routing_decisions"), self.table("self_heal_events"), self.table("recovery_events")
        st = self.table("autonomy_streaks")
        out = {f"stats_{n}": df for n, df in self.export_stats().items()}
        out |= {"subscription": daily.roi(d, "calendar", as_of=day), "subscription_models": daily.model_costs(
            daily.to_long(d))}
        out |= {"outcomes_recent": sessions.recent_with_outcomes(s, o), "outcomes_totals": sessions.outcome_totals(s),
                "outcomes_quality": sessions.quality_hist(o), "outcomes_models": sessions.outcome_by_model(s),
                "outcomes_sizes": sessions.size_buckets(s), "outcomes_daily": sessions.outcome_daily(s, o)}
        out |= {"routing_totals": routing.nonzero_dq(r), "routing_daily": routing.daily_trend(r),
                "routing_share": routing.model_share(r), "routing_accuracy": routing.pooled_accuracy(o, r),
                "routing_components": routing.dq_components(r), "routing_complexity": routing.complexity_by_model(r)}
        out |= {"recovery_stats": recovery.stats(heal, rec), "recovery_categories": recovery.by_category(heal, rec),
                # Ages of up to seven whole days: eight folders at most are opened.
                "recovery_timeline": recovery.timeline(self.table("self_heal_events", since=as_of - 8 * 86400), as_of=as_of),
                "recovery_recent": recovery.recent_actions(heal, rec)}
        out |= {"autonomy_top": streaks.top_streaks(st), "autonomy_stats": streaks.streak_stats(st),
                "autonomy_daily": streaks.streak_daily(st, as_of=as_of),
                "autonomy_histogram": streaks.streak_histogram(st)}
        if clash := set(out) & set(self._metrics):
            raise ValueError(f"there are panels {sorted(clash)}: register the metrics by other names")
        return out | {name: metric(self, as_of=as_of, day=day) for name, (metric, _) in self._metrics.items()}

    def live_snapshot(self, *, as_of: int, day: str) -> DataFrame:
        return live_snapshot(self.table("daily_stats"), self.table("sessions"), self.table("activity_events"),
                             as_of=as_of, day=day)


def live_snapshot(daily_stats: DataFrame, session_rows: DataFrame, activity: DataFrame, *, as_of: int,
                  day: str) -> DataFrame:
    """What a live view polls, as (section, key, metric, value) rows: totals, the
    current day, open or just ended sessions, the latest session, and data age."""
    from tracewell.operators.health import stream_freshness
    from tracewell.operators.windows import arg_max
    d = daily_stats
    messages = F.col("opus_messages") + F.col("sonnet_messages") + F.col("haiku_messages")
    today = filters.on_day(d, "date", day).agg(
        F.coalesce(F.sum(messages), F.lit(0)).alias("messages"),
        F.coalesce(F.sum("session_count"), F.lit(0)).alias("sessions"),
        F.coalesce(F.sum("tool_calls"), F.lit(0)).alias("tools"))
    active = filters.open_or_recent(session_rows, "ended_at", 5, as_of=as_of).agg(F.count(F.lit(1)).alias("active"))
    latest = arg_max(session_rows, "started_at", ["id", "message_count", "tool_count"], ["id"])
    return daily.metric_rows({
        "totals": daily.totals(d).select("total_messages", "total_sessions", "total_tools", "total_cost"),
        "today": today, "sessions": active, "latest_session": latest,
        "data_age": stream_freshness(activity, "timestamp", as_of=as_of)}, {"latest_session": "id",
                                                                         "data_age": "freshness"})
