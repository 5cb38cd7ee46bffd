"""Rows of the seeded store, and helpers to make rows."""

from tracewell.schemas import SCHEMAS


def epoch(text: str) -> int:
    from datetime import datetime, timezone
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp())


def frame(spark, name, rows):
    """Rows given as dicts; absent columns are NULL."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def seeded(spark):
    """The tables of the seeded store."""
    def day(date, o, s, h, oi, oo, oc, si, so, sc, hi, ho, hc, n, t, cost):
        return {"date": date, "opus_messages": o, "sonnet_messages": s, "haiku_messages": h, "opus_tokens_in": oi,
                "opus_tokens_out": oo, "opus_cache_read": oc, "sonnet_tokens_in": si, "sonnet_tokens_out": so,
                "sonnet_cache_read": sc, "haiku_tokens_in": hi, "haiku_tokens_out": ho, "haiku_cache_read": hc,
                "session_count": n, "tool_calls": t, "cost_estimate": cost}

    # Days, sessions, decisions, outcomes and counters whose totals are known results.
    daily = [
        day("2026-02-10", 80, 20, 5, 500000, 150000, 4000000, 100000, 30000, 800000, 10000, 3000, 50000, 12, 450, 120.5),
        day("2026-02-11", 95, 15, 3, 600000, 180000, 5000000, 80000, 25000, 700000, 5000, 2000, 30000, 15, 520, 145.3),
        day("2026-02-12", 110, 25, 8, 700000, 200000, 6000000, 120000, 35000, 900000, 15000, 5000, 60000, 18, 680,
            175.8)]
    sessions = [
        {"id": "sess-001", "project_path": "project-a", "started_at": epoch("2026-02-12T10:00:00"),
         "ended_at": epoch("2026-02-12T11:30:00"), "model": "opus", "message_count": 85, "tool_count": 120,
         "outcome": "success", "quality_score": 0.85, "cost_estimate": 55.0},
        {"id": "sess-002", "project_path": "project-b", "started_at": epoch("2026-02-12T14:00:00"),
         "ended_at": epoch("2026-02-12T15:00:00"), "model": "sonnet", "message_count": 40, "tool_count": 60,
         "outcome": "abandoned", "quality_score": 0.72, "cost_estimate": 18.0},
        {"id": "sess-003", "project_path": "project-a", "started_at": epoch("2026-02-12T16:00:00"), "model": "opus",
         "message_count": 20, "tool_count": 30, "cost_estimate": 10.0}]
    t = epoch("2026-02-12T10:00:00")
    routing = [
        {"id": 1, "timestamp": t, "query_hash": "h1", "complexity": 0.3, "selected_model": "sonnet", "dq_score": 0.65,
         "dq_validity": 0.7, "dq_specificity": 0.6, "dq_correctness": 0.6},
        {"id": 2, "timestamp": t + 3600, "query_hash": "h2", "complexity": 0.8, "selected_model": "opus",
         "dq_score": 0.85, "dq_validity": 0.9, "dq_specificity": 0.8, "dq_correctness": 0.85},
        {"id": 3, "timestamp": t + 7200, "query_hash": "h3", "complexity": 0.1, "selected_model": "haiku",
         "dq_score": 0.45, "dq_validity": 0.5, "dq_specificity": 0.4, "dq_correctness": 0.45}]
    outcomes = [
        {"id": 1, "timestamp": t, "session_id": "sess-001", "outcome": "success", "quality_score": 4.2,
         "complexity": 0.7, "model_used": "opus"},
        {"id": 2, "timestamp": t, "session_id": "sess-002", "outcome": "abandoned", "quality_score": 2.5,
         "complexity": 0.3, "model_used": "sonnet"}]
    usage = [{"tool_name": n, "total_calls": c, "success_count": o, "failure_count": f, "avg_duration_ms": d}
             for n, c, o, f, d in (("Read", 5000, 4980, 20, 45.2), ("Edit", 3000, 2950, 50, 120.5),
                                   ("Bash", 2000, 1900, 100, 350.0), ("Grep", 1500, 1500, 0, 80.3))]
    hourly = [{"date": "2026-02-12", "hour": h, "session_count": s, "message_count": m}
              for h, s, m in ((10, 3, 50), (14, 2, 30), (16, 1, 20))]
    # Rows of our own from here on.
    heal = [{"id": 40 + i, "timestamp": 1_770_000_000 + 60 * i, "error_pattern": p, "success": ok} for i, (p, ok) in enumerate((
        ("dns_timeout", 1), ("full_disk", 0), ("dns_timeout", 1), ("bad_cert", 1), ("full_disk", 0), ("slow_query", 1)))]
    rec = [{"id": 70 + i, "timestamp": 1_770_001_000 + 60 * i, "error_type": p, "success": ok, "attempts": 2} for i, (p, ok) in
           enumerate((("restart", 1), ("failover", 0), ("rollback", 1), ("restart", 1)))]
    contacts = [{"id": i, "name": n, "category": c, "updated_at": 1} for i, n, c in (
        ("p7", "Harbour Mill", "supplier"), ("p8", "Quarry Lane", "press"), ("p9", "Tidewater", "supplier"),
        ("p10", "Old Foundry", "reseller"))]
    deals = [{"id": i, "contact_id": c, "stage": s, "value": v, "updated_at": 1} for i, c, s, v in (
        ("x1", "p7", "prospect", 1250.5), ("x2", "p7", "lost", 900.0), ("x3", "p9", "meeting", 310.25), ("x4", "p10", "won", 77.0),
        ("x5", "p7", "meeting", 64.0))]
    inter = [{"id": "n1", "contact_id": "p7", "type": "call", "follow_up": "send list", "follow_up_date": "2026-02-21"},
             {"id": "n2", "contact_id": "p7", "type": "visit"}, {"id": "n3", "contact_id": "p10", "type": "letter"},
             {"id": "n4", "contact_id": "p9", "type": "call", "follow_up": "ask again", "follow_up_date": "2026-03-30"}]
    rows = {"daily_stats": daily, "sessions": sessions, "routing_decisions": routing,
            "session_outcome_events": outcomes, "self_heal_events": heal, "recovery_events": rec,
            "tool_usage": usage, "hourly_activity": hourly, "crm_contacts": contacts, "crm_deals": deals,
            "crm_interactions": inter}
    return {n: frame(spark, n, r) for n, r in rows.items()}
