"""The store facade: writes, rewrites and reads of whole tables."""

import pytest

from rows import epoch, frame
from tracewell.sinks.batches import clock
from tracewell.sinks.panels import export_panels
from tracewell.store import TelemetryStore

NOW = epoch("2026-02-13T00:00:00")


@pytest.fixture(scope="module")
def lake(spark, store, tmp_path_factory):
    t = TelemetryStore(spark, str(tmp_path_factory.mktemp("store")))
    t.log_sessions(store["sessions"])
    t.update_daily_stats(store["daily_stats"])
    t.log_routing_decisions(store["routing_decisions"])
    for name in ("session_outcome_events", "self_heal_events", "recovery_events"):
        t.append(name, store[name])
    return t


def test_reads(lake):
    assert [r.id for r in lake.get_sessions(30, as_of=NOW).collect()] == ["sess-003", "sess-002", "sess-001"]
    assert [r.id for r in lake.get_sessions(30, "project-b", as_of=NOW).collect()] == ["sess-002"]
    assert {r.outcome: r.n for r in lake.get_session_outcomes().collect()} == {"success": 1, "abandoned": 1}
    assert lake.get_totals().first().total_messages == 361
    assert [r.date for r in lake.get_daily_stats(1, as_of="2026-02-12").collect()] == ["2026-02-12", "2026-02-11"]
    r = lake.get_routing_stats(7, as_of=NOW).first()
    assert (r.total, r.opus_count) == (3, 1) and r.avg_dq == pytest.approx(0.65)


def test_logging_twice_keeps_one_row(spark, lake):
    again = frame(spark, "sessions", [{"id": "sess-003", "model": "haiku", "started_at": NOW - 60}])
    lake.log_sessions(again)
    lake.log_sessions(again)
    rows = {r.id: r for r in lake.table("sessions").collect()}
    assert len(rows) == 3 and rows["sess-003"].model == "haiku" and rows["sess-003"].message_count is None


def test_counters(spark, lake):
    calls = spark.createDataFrame([("Read", 1, 5, 3), ("Read", 0, 9, 2)],
                                  "tool_name string, success int, timestamp long, calls long")
    lake.update_tool_usage(calls, "queue", 1)
    lake.update_tool_usage(calls, "queue", 1)
    r = lake.get_tool_stats().first()
    assert (r.total_calls, r.success_count, r.failure_count, r.last_used) == (5, 3, 2, 9)
    hour = spark.createDataFrame([("2026-02-12", 10, 3, 50)],
                                 "date string, hour long, session_count long, message_count long")
    lake.update_hourly_activity(hour)
    lake.update_hourly_activity(hour)
    assert [tuple(r) for r in lake.get_hourly_pattern().collect()] == [(10, 6)]


def test_feedback(spark, lake):
    number = lake.record_routing_feedback(spark.createDataFrame([("h2", 1)], "query_hash string, verdict long"))
    lake.record_routing_feedback(spark.createDataFrame([("h2", 1)], "query_hash string, verdict long"), number=number)
    assert {r.query_hash: r.success for r in lake.table("routing_decisions").collect()} == {
        "h1": None, "h2": 1, "h3": None}


def test_streaks_and_panels(spark, lake, tmp_path):
    events = [{"id": i, "timestamp": NOW - 4000 + 20 * i, "tool_name": "Edit", "success": 1, "context": "/p"}
              for i in range(10)]
    lake.append("tool_events", frame(spark, "tool_events", events))
    lake.rebuild_streaks()
    lake.rebuild_streaks()
    s = lake.table("autonomy_streaks").collect()
    assert len(s) == 1 and s[0].duration_seconds == 180 and s[0].top_tools == {"Edit": 10}
    panels = lake.panels(as_of=NOW, day="2026-02-13")
    written = export_panels(panels, str(tmp_path))
    assert len(written) == len(panels) > 25
    assert spark.read.json(f"{tmp_path}/autonomy_stats").first().total_streaks == 1
    live = {(r.section, r.metric): r.value for r in lake.live_snapshot(as_of=NOW, day="2026-02-12").collect()}
    assert live["totals", "total_messages"] == 361 and live["today", "messages"] == 143


def test_fold_changes_nothing(spark, store, tmp_path):
    lake = TelemetryStore(spark, str(tmp_path))
    lake.log_sessions(store["sessions"])
    lake.log_sessions(frame(spark, "sessions", [{"id": "sess-001", "model": "haiku"}]))
    lake.update_tool_usage(spark.createDataFrame([("Read", 1, 5)], "tool_name string, success int, timestamp long"))
    before = {n: sorted(map(repr, lake.table(n).collect())) for n in ("sessions", "tool_usage", "daily_stats")}
    lake.fold(clock())
    assert before == {n: sorted(map(repr, lake.table(n).collect())) for n in before} and len(before["sessions"]) == 3


def test_events_lie_in_days(spark, tmp_path):
    lake = TelemetryStore(spark, str(tmp_path))
    day = 86400
    rows = spark.createDataFrame([(i, NOW - i * day) for i in range(5)] + [(9, None)], "id long, timestamp long")
    lake.append("tool_events", rows)
    recent = lake.table("tool_events", since=NOW - day)
    assert sorted(r.id for r in recent.filter(f"timestamp >= {NOW - day}").collect()) == [0, 1]
    assert lake.table("tool_events").count() == 6 and "event_date" not in lake.table("tool_events").columns
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_metrics_of_ones_own(spark, store, tmp_path):
    lake = TelemetryStore(spark, f"{tmp_path}/lake")
    lake.log_sessions(store["sessions"])
    lake.register_metric("by_project", lambda s, *, as_of, day: s.table("sessions").filter(f"started_at <= {as_of}").groupBy(
        "project_path").count(), "project_path")
    panels = lake.panels(as_of=NOW, day="2026-02-13")
    assert export_panels(panels, f"{tmp_path}/out", ["by_project"]) == ["by_project"]
    assert {r.project_path: r["count"] for r in spark.read.json(f"{tmp_path}/out/by_project").collect()} == {"project-a": 2, "project-b": 1}
    for name in ("by_project", "no/name"):
        with pytest.raises(ValueError):
            lake.register_metric(name, lambda s, *, as_of, day: s.table("sessions"), "id")
    lake.register_metric("routing_daily", lambda s, *, as_of, day: s.table("sessions"), "id")
    with pytest.raises(ValueError, match="routing_daily"):
        lake.panels(as_of=NOW, day="2026-02-13")
    live = lake.live_metrics(lambda: (NOW, "2026-02-13"))
    assert live["by_project"][1] == "project_path" and live["by_project"][0](None).count() == 2
