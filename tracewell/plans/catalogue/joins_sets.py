"""Joins, top-k, set operations."""

from pyspark.sql import functions as F

from tracewell.functions.exprs import hour_of, rnd
from tracewell.functions.scoring import PRICES, token_cost
from tracewell.operators import filters as fl
from tracewell.operators import joins as j
from tracewell.operators import ordering as o
from tracewell.operators import tools as t
from tracewell.plans.registry import EVENTS_NOW as NOW
from tracewell.plans.registry import LINES_NOW, avg, cif, day, hour, isum, pct, query, r

query("d01_attach_outcomes", lambda b: j.attach_outcomes(
    b.sessions.select("id", "outcome", "message_count"),
    b.session_outcome_events.select("session_id", "quality_score", "complexity")), """
    SELECT s.id, s.outcome, s.message_count, o.quality_score AS quality, o.complexity FROM sessions s
    LEFT JOIN session_outcome_events o ON o.session_id = s.id""")
query("d01_attach_outcomes_dedupe", lambda b: j.attach_outcomes(
    b.sessions.select("id", "outcome"), b.session_outcome_events, dedupe=True), f"""
    SELECT s.id, s.outcome, q AS quality, c AS complexity FROM sessions s LEFT JOIN (SELECT session_id,
    {avg('quality_score')} AS q, {avg('complexity')} AS c
    FROM session_outcome_events GROUP BY 1) o ON o.session_id = s.id""")
query("d05_interval_join", lambda b: j.interval_join(
    b.git_events.select(F.col("timestamp").alias("at_ts")).distinct(),
    b.sessions.select("id", "started_at", "ended_at"), at="at_ts", start="started_at", end="ended_at",
    order=[F.col("started_at").desc(), F.col("id")]).select("at_ts", "id", "match_rank"), """
    SELECT at_ts, id, match_rank FROM (SELECT at_ts, id, row_number() OVER (PARTITION BY at_ts ORDER BY started_at DESC, id)
    AS match_rank FROM (SELECT DISTINCT timestamp AS at_ts FROM git_events) JOIN sessions
    ON started_at <= at_ts AND (ended_at IS NULL OR ended_at >= at_ts)) WHERE match_rank <= 5""")
query("d06_calendar_fill", lambda b: j.calendar_fill(
    b.daily_stats.select("date", "session_count", "tool_calls"), "date", ["session_count", "tool_calls"],
    start="1994-12-20", end="2001-12-31"), """
    SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS date, coalesce(session_count, 0) AS session_count,
           coalesce(tool_calls, 0) AS tool_calls
    FROM generate_series(DATE '1994-12-20', DATE '2001-12-31', INTERVAL 1 DAY) g(x)
    LEFT JOIN daily_stats ON date = CAST(CAST(x AS DATE) AS VARCHAR)""")
EXP = "FROM expertise_routing_events"
query("d11_f15_share_of_group", lambda b: j.share_of(b.expertise_routing_events, "domain", "chosen_model"), f"""
    WITH c AS (SELECT domain, chosen_model, count(*) AS n {EXP} GROUP BY 1, 2)
    SELECT *, {pct('n', 'sum(n) OVER (PARTITION BY domain)')} AS pct FROM c""")
query("d12_dominant_model", lambda b: j.dominant(b.expertise_routing_events, "domain", "chosen_model"), f"""
    WITH c AS (SELECT domain, chosen_model, count(*) AS n {EXP} GROUP BY 1, 2)
    SELECT domain, chosen_model, n, {pct('n', '(SELECT sum(n) FROM c d WHERE d.domain = c.domain)')} AS pct FROM c
    WHERE n = (SELECT max(n) FROM c d WHERE d.domain = c.domain)""")
query("d13_domain_matrix", lambda b: j.matrix(
    b.expertise_routing_events, "domain", "chosen_model", ("haiku", "opus", "sonnet", "flash")), f"""
    SELECT domain, {', '.join(f"{cif(f'chosen_model = {chr(39)}{m}{chr(39)}')} AS {m}" for m in
                              ('haiku', 'opus', 'sonnet', 'flash'))} {EXP} GROUP BY 1""")
query("d14_price_lookup", lambda b: j.lookup_or_default(
    b.sessions.select("id", "model", "input_tokens"), "model", PRICES, "opus"), """
    SELECT id, s.model, input_tokens, coalesce(i, 5e0) AS input, coalesce(o, 25e0) AS output, coalesce(c, 0.5e0)
    AS cache FROM sessions s LEFT JOIN (VALUES ('opus', 5e0, 25e0, 0.5e0), ('sonnet', 3e0, 15e0, 0.3e0),
    ('haiku', 1e0, 5e0, 0.1e0)) v(m, i, o, c) ON m = s.model""")
query("l01_session_cost", lambda b: b.sessions.select("id", rnd(token_cost(
    "model", "input_tokens", "output_tokens", "cache_read_tokens"), 6).alias("cost")), f"""
    SELECT id, {r('''(input_tokens * coalesce(i, 5e0) + output_tokens * coalesce(o, 25e0)
    + cache_read_tokens * coalesce(c, 0.5e0)) / 1e6''', 6)} AS cost FROM sessions s LEFT JOIN (VALUES
    ('opus', 5e0, 25e0, 0.5e0), ('sonnet', 3e0, 15e0, 0.3e0), ('haiku', 1e0, 5e0, 0.1e0)) v(m, i, o, c)
    ON m = s.model""")
query("c04_null_and_in_tests", lambda b: b.routing_decisions.filter(
    F.col("success").isNotNull() & ~F.col("selected_model").isin("opus", "flash") & (F.col("query_hash") != "1")).agg(
    F.count(F.lit(1)).alias("n")), """
    SELECT count(*) AS n FROM routing_decisions WHERE success IS NOT NULL AND selected_model NOT IN ('opus', 'flash')
    AND query_hash <> '1'""")
query("c07_plausible_events", lambda b: fl.not_before(b.activity_events, "timestamp", 1705276800).agg(
    F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("earliest")),
      "SELECT count(*) AS n, min(timestamp) AS earliest FROM activity_events WHERE timestamp > 1705276800")
query("c09_text_contains", lambda b: fl.text_contains(b.documents, "text", "THE OR").select("doc_id", "lang", "source"),
      "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'the or')")
query("c10_prefix_split", lambda b: b.sync_events.groupBy(
    fl.has_prefix("tool", "session_").cast("bigint").alias("is_session")).agg(F.count(F.lit(1)).alias("n")),
      "SELECT CAST(tool LIKE 'session!_%' ESCAPE '!' AS BIGINT) AS is_session, count(*) AS n FROM sync_events GROUP BY 1")
query("c11_rename_projection", lambda b: fl.rename_with_zero(
    b.sessions, {"message_count": "messageCount", "tool_count": "toolCallCount", "ended_at": "endedAt"}, ("id",)), """
    SELECT id, coalesce(message_count, 0) AS messageCount, coalesce(tool_count, 0) AS toolCallCount,
           coalesce(ended_at, 0) AS endedAt FROM sessions""")
query("c14_predictions_from_scores", lambda b: fl.predictions_from_scores(b.dq_log), """
    SELECT ts, substr(coalesce(query, ''), 1, 50) AS query, coalesce(model, 'sonnet') AS predicted_model,
           coalesce(model, 'sonnet') AS actual_model, coalesce(dqScore, 0.5e0) AS dq_score,
           coalesce(complexity, 0.5e0) AS complexity, CAST(1 AS BIGINT) AS correct FROM dq_log WHERE ts <> 0""")
query("c15_flagged_notes", lambda b: fl.flagged_notes(b.learnings, "src3", ("the", "est")), """
    SELECT id, category, date, CAST(contains(lower(content), 'the') AND contains(lower(content), 'est') AS BIGINT)
           AS flagged FROM (SELECT * FROM learnings WHERE project = 'src3' ORDER BY date DESC, id LIMIT 50)""")
query("a09_tail_scan", lambda b: o.latest(b.events_k.select("event_id", "timestamp", "k"), "timestamp", 1000, "event_id"),
      "SELECT event_id, timestamp, k FROM events_k ORDER BY timestamp DESC, event_id DESC LIMIT 1000")
query("g01_activity_timeline", lambda b: o.latest(fl.within_days(
    b.since(NOW - 7 * 86400).activity_events, "timestamp", 7, as_of=NOW), "timestamp", 100), f"""
    SELECT * FROM activity_events WHERE timestamp > {NOW - 7 * 86400} ORDER BY timestamp DESC, id DESC LIMIT 100""")
query("g01_session_outcomes", lambda b: o.top(fl.within_days(
    b.since(LINES_NOW - 60 * 86400).session_outcome_events, "timestamp", 60, as_of=LINES_NOW), 50, "-timestamp", "-id", "-quality_score"), f"""
    SELECT * FROM session_outcome_events WHERE timestamp > {LINES_NOW - 60 * 86400}
    ORDER BY timestamp DESC, id DESC, quality_score DESC LIMIT 50""")
query("g02_top_sessions", lambda b: o.top(b.sessions.select("id", "message_count", "tool_count"), 20,
                                          "-message_count", "id"),
      "SELECT id, message_count, tool_count FROM sessions ORDER BY message_count DESC, id LIMIT 20")
query("g03_counter_top", lambda b: o.counter(b.file_changes, "file", "file", 5),
      "SELECT file, count(*) AS n FROM file_changes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
query("g08_multi_key_sort", lambda b: o.top(b.tool_events.filter("success = 0").groupBy(
    "tool_name", "error_message").agg(F.count(F.lit(1)).alias("failures")), 12, "-failures", "-error_message",
    "tool_name"), """
    SELECT tool_name, error_message, count(*) AS failures FROM tool_events WHERE success = 0 GROUP BY 1, 2
    ORDER BY 3 DESC, 2 DESC, 1 LIMIT 12""")
query("g10_log_counts", lambda b: o.logs_with_counts({
    "routing": (b.routing_decisions, "timestamp", "id"), "sessions": (b.session_outcome_events, "timestamp", "id"),
    "git": (b.git_events, "timestamp", "id")}, 100), """
    SELECT log, n AS rows, least(n, 100) AS shown FROM (SELECT 'routing' AS log, count(*) AS n FROM routing_decisions
    UNION ALL SELECT 'sessions', count(*) FROM session_outcome_events UNION ALL SELECT 'git', count(*) FROM git_events)""")
query("g10_coordinator_history", lambda b: o.latest(
    b.coordinator_events.select("id", "timestamp", "agent_id", "action"), "timestamp", 20),
      "SELECT id, timestamp, agent_id, action FROM coordinator_events ORDER BY timestamp DESC, id DESC LIMIT 20")
query("h01_union_events", lambda b: o.union_events([
    (b.self_heal_events, {"ts": "timestamp", "category": "error_pattern", "success": "success"}),
    (b.recovery_events, {"ts": "timestamp", "category": "error_type", "success": "success"})]), """
    SELECT timestamp AS ts, error_pattern AS category, success FROM self_heal_events
    UNION ALL SELECT timestamp, error_type, success FROM recovery_events""")
query("h04_distinct_values", lambda b: o.distinct_values(b.tool_events, tool="tool_name", context="context",
                                                         hour=hour_of("timestamp")), f"""
    SELECT DISTINCT 'tool' AS field, tool_name AS value FROM tool_events
    UNION ALL SELECT DISTINCT 'context', context FROM tool_events
    UNION ALL SELECT DISTINCT 'hour', CAST({hour('timestamp')} AS VARCHAR) FROM tool_events""")
query("h05_newest_per_key", lambda b: o.newest_per_key(
    b.tool_events.select("session_id", "id", "timestamp", "tool_name", "success"), ["session_id"],
    ["timestamp", "id"]), """
    SELECT session_id, id, timestamp, tool_name, success FROM (SELECT *, row_number() OVER (PARTITION BY session_id
    ORDER BY timestamp DESC, id DESC) AS rn FROM tool_events) WHERE rn = 1""")
query("d06_hourly_tool_volume", lambda b: t.hourly_calls(b.tool_events, as_of=NOW, days=365),
      f"SELECT {hour('timestamp')} AS hour, count(*) AS calls FROM tool_events GROUP BY 1")
query("d07_commits_on_activity", lambda b: b.daily_stats.select("date", "tool_calls").join(
    b.git_events.groupBy(F.col("timestamp")).agg(F.sum("files_changed").alias("files")).select(
        F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("timestamp") / 86400).cast("int")).cast("string")
        .alias("date"), "files"), "date", "left").select("date", "tool_calls", F.coalesce("files", F.lit(0)).alias("files")),
      f"""SELECT date, tool_calls, coalesce(files, 0) AS files FROM daily_stats LEFT JOIN (SELECT {day('timestamp')}
      AS date, {isum('files_changed')} AS files FROM git_events GROUP BY 1) USING (date)""")
