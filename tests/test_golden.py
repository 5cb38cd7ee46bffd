"""Known answers on the seeded store, and behaviour on an empty one."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import crm, daily, recovery, routing, sessions, tools
from tracewell.operators.ordering import top


def one(df):
    return df.first().asDict()


def test_totals(store):
    t = one(daily.totals(store["daily_stats"]))
    assert (t["total_messages"], t["total_sessions"], t["total_tools"]) == (361, 45, 1650)
    assert (t["opus_messages"], t["sonnet_messages"], t["haiku_messages"]) == (285, 60, 16)
    assert t["total_cost"] == pytest.approx(441.6)


def test_tokens_and_costs(store):
    rows = {r.model: r for r in daily.model_costs(daily.to_long(store["daily_stats"])).collect()}
    assert (rows["opus"].tokens_in, rows["opus"].tokens_out) == (1800000, 530000)
    assert rows["opus"].cost == pytest.approx(29.75)
    assert rows["sonnet"].cost == pytest.approx(2.97)
    assert rows["haiku"].cost == pytest.approx(0.094)


def test_views(store):
    d = {r.date: r for r in daily.view_daily_costs(store["daily_stats"]).collect()}
    assert d["2026-02-10"].api_cost == pytest.approx(7.02)
    assert d["2026-02-10"].cache_savings == pytest.approx(2.425)
    m = one(daily.view_model_distribution(store["daily_stats"]))
    assert (m["opus_pct"], m["sonnet_pct"], m["haiku_pct"]) == (78.9, 16.6, 4.4)
    assert one(daily.view_token_totals(store["daily_stats"]))["cache_efficiency"] == 86.4


def test_roi_variants_differ(store):
    got = {v: one(daily.roi(store["daily_stats"], v, as_of="2026-02-13")) for v in daily.ROI_VARIANTS}
    assert got["one_month"]["paid"] == 200 and got["calendar"]["paid"] == 200
    assert got["day_rate"]["paid"] == pytest.approx(20.0)
    assert got["calendar"]["total_value"] == pytest.approx(32.81)
    with pytest.raises(ValueError):
        daily.roi(store["daily_stats"], "other", as_of="2026-02-13")


def test_longest_and_outcomes(store):
    assert one(sessions.longest(store["sessions"]))["message_count"] == 85
    t = one(sessions.outcome_totals(store["sessions"]))
    assert (t["total"], t["success"], t["abandoned"], t["other"]) == (3, 1, 1, 0)
    sizes = {r["size"]: r.n for r in sessions.size_buckets(store["sessions"]).collect()}
    assert sizes == {"large": 1, "medium": 1, "small": 1}
    minutes = {r.id: r.duration_minutes for r in sessions.recent_sessions(store["sessions"]).collect()}
    assert minutes == {"sess-001": 90.0, "sess-002": 60.0, "sess-003": None}


def test_routing(store):
    r = one(routing.nonzero_dq(store["routing_decisions"]))
    assert r["total"] == 3 and r["avg_dq"] == pytest.approx(0.65)
    acc = one(routing.pooled_accuracy(store["session_outcome_events"], store["routing_decisions"]))
    assert acc == {"feedback_count": 2, "accuracy": 50.0}


def test_accuracy_falls_back_to_score(store, empty_store):
    acc = one(routing.pooled_accuracy(empty_store["session_outcome_events"], store["routing_decisions"]))
    assert acc["accuracy"] == 65.0


def test_recovery(store):
    s = one(recovery.stats(store["self_heal_events"], store["recovery_events"]))
    assert s == {"total": 10, "auto_fix": 4, "auto_fix_rate": 40.0, "success_rate": 70.0}


def test_counter_table(store):
    assert top(store["tool_usage"], 1, "-total_calls", "tool_name").first().tool_name == "Read"
    assert one(tools.weighted_success(store["tool_usage"]))["success_rate"] == 98.5


def test_crm(store):
    s = {r.metric: r.value for r in crm.stats(store["crm_contacts"], store["crm_deals"], store["crm_interactions"],
                                              as_of="2026-02-20").collect()}
    assert s == {"total_contacts": 4, "active_deals": 3, "won_deals": 1, "pipeline_value": 1624.75,
                 "total_interactions": 4, "follow_ups_due": 1}
    a = {r.id: (r.deals, r.interactions) for r in crm.contact_activity(
        store["crm_contacts"], store["crm_deals"], store["crm_interactions"]).collect()}
    assert a == {"p7": (3, 2), "p8": (0, 0), "p9": (1, 1), "p10": (1, 1)}
    board = [r.id for r in crm.deal_board(store["crm_deals"], store["crm_contacts"]).orderBy("position").collect()]
    assert board == ["x1", "x3", "x5", "x4", "x2"]


def test_fan_out_is_kept_or_removed(spark, store):
    extra = store["session_outcome_events"].unionByName(store["session_outcome_events"])
    kept = one(sessions.outcome_daily(store["sessions"], extra))
    assert (kept["sessions"], kept["messages"]) == (5, 2 * 85 + 2 * 40 + 20)
    single = one(sessions.outcome_daily(store["sessions"], extra, dedupe=True))
    assert (single["sessions"], single["messages"]) == (3, 145)


def test_empty_store(empty_store):
    e = empty_store
    assert one(daily.totals(e["daily_stats"])) == {
        "total_messages": 0, "total_sessions": 0, "total_tools": 0, "opus_messages": 0, "sonnet_messages": 0,
        "haiku_messages": 0, "total_cost": 0.0}
    assert one(routing.nonzero_dq(e["routing_decisions"])) == {"total": 0, "avg_dq": 0.0}
    assert one(recovery.stats(e["self_heal_events"], e["recovery_events"]))["total"] == 0
    assert one(tools.overview(e["tool_events"]))["success_rate"] == 100.0
    assert one(tools.unweighted_success(e["tool_events"]))["success_rate"] == 100.0
    assert sessions.outcome_totals(e["sessions"]).first().total_messages == 0
    assert sessions.longest(e["sessions"]).count() == 0
    assert one(daily.roi(e["daily_stats"], "active_rows", as_of="2026-01-01"))["paid"] == 200.0
    assert tools.daily_kinds(e["tool_events"], since=0).count() == 0
    assert {r.calls for r in tools.category_mix(e["tool_events"]).collect()} == {0}


def test_unknown_model_uses_default_price(spark):
    from tracewell.functions.scoring import token_cost
    df = spark.createDataFrame([("opus",), ("mystery",), (None,)], "m string")
    costs = [r.c for r in df.select(token_cost("m", F.lit(1000000), F.lit(0), F.lit(0)).alias("c")).collect()]
    assert costs == [5.0, 5.0, 5.0]
