"""Sources, sinks and stream shapes as batch queries over the bound tables."""

from pyspark.sql import functions as F

from tracewell.functions.exprs import day_of, hour_of
from tracewell.operators.ordering import newest_per_key
from tracewell.plans.registry import cif, day, dsum, hour, isum, query, r
from tracewell.sinks import panels as pn
from tracewell.sinks import upserts as up
from tracewell.sources import incremental as inc
from tracewell.sources.jsonl import parse_lines, split_bad
from tracewell.sources.tables import parse_json_col
from tracewell.streaming import export as ex
from tracewell.store import live_snapshot
from tracewell.streaming import live

HALF = 1705276800   # 2024-01-15, splits the event log into stored and new rows

query("a01_jsonl_records", lambda b: parse_lines(b.json_lines, "k bigint", text="line").groupBy("k").agg(
    F.count(F.lit(1)).alias("n")), """
    SELECT k, count(*) AS n FROM events_k WHERE event_type NOT IN ('error', 'signup') GROUP BY 1""")
query("b10_quarantine_split", lambda b: split_bad(b.json_lines, "line")[0].select(F.lit("kept").alias("side"), "id")
      .unionByName(split_bad(b.json_lines, "line")[1].select(F.lit("removed").alias("side"), "id")), """
    SELECT CASE WHEN event_type = 'error' THEN 'removed' ELSE 'kept' END AS side, event_id AS id FROM events_k
    WHERE event_type <> 'signup'""")
query("a06_region_nation", lambda b: b.nation.join(b.region, b.nation.n_regionkey == b.region.r_regionkey).groupBy(
    "r_name").agg(F.count(F.lit(1)).alias("nations")),
      "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
query("a07_second_store", lambda b: b.crm_interactions.join(
    b.sessions.withColumn("cid", F.substring("project_path", 5, 20).cast("bigint")).groupBy("cid").agg(
        F.count(F.lit(1)).alias("sessions")), F.col("contact_id") == F.col("cid"), "left").groupBy("type").agg(
    F.sum(F.coalesce("sessions", F.lit(0))).alias("sessions")), f"""
    SELECT type, {isum('coalesce(n, 0)')} AS sessions FROM crm_interactions LEFT JOIN (SELECT
    CAST(substr(project_path, 5) AS BIGINT) AS cid, count(*) AS n FROM sessions GROUP BY 1) ON cid = contact_id
    GROUP BY 1""")
query("a10_since", lambda b: inc.since(b.since(HALF).activity_events, "timestamp", HALF).groupBy("event_type").agg(
    F.count(F.lit(1)).alias("n")),
      f"SELECT event_type, count(*) AS n FROM activity_events WHERE timestamp > {HALF} GROUP BY 1")
query("a11_new_rows", lambda b: inc.new_rows(
    b.activity_events, b.activity_events.filter(F.col("timestamp") <= HALF), "timestamp").select("id", "timestamp"), f"""
    SELECT id, timestamp FROM activity_events WHERE timestamp > (SELECT max(timestamp) FROM activity_events
    WHERE timestamp <= {HALF})""")
query("t19_missing_rows", lambda b: inc.missing_rows(
    b.sessions.select("id", "started_at"), b.session_outcome_events.select(F.col("session_id").alias("id")), "id"),
      "SELECT id, started_at FROM sessions WHERE id NOT IN (SELECT session_id FROM session_outcome_events)")
query("a10_high_water", lambda b: inc.high_water(b.activity_events, "timestamp"),
      "SELECT max(timestamp) AS last_sync_ts FROM activity_events")
query("a12_json_column", lambda b: parse_json_col(b.sync_events, "metadata", "command string, success boolean, "
                                                  "exit_code bigint", "m").select(
    "id", F.col("m.command").alias("command"), F.col("m.exit_code").alias("exit_code")), """
    SELECT id, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.command') END AS command,
           CASE WHEN json_valid(metadata) THEN CAST(json_extract_string(metadata, '$.exit_code') AS BIGINT) END
           AS exit_code FROM sync_events""")
query("b01_panel_json", lambda b: pn.panel_json(b.tool_events.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"))),
      """SELECT '{"tool_name":"' || tool_name || '","calls":' || count(*) || '}' AS json FROM tool_events
      GROUP BY tool_name""")


def usage(b, new):
    rows = b.tool_events.filter(F.col("timestamp") > HALF if new else F.col("timestamp") <= HALF)
    return up.tool_usage_delta(rows)


USAGE = f"""SELECT tool_name, count(*) AS total_calls, {cif('success = 1')} AS success_count,
            {cif('success = 0')} AS failure_count, max(timestamp) AS last_used FROM tool_events GROUP BY 1"""
query("b06_j05_upsert_add", lambda b: up.upsert_add(
    usage(b, False), usage(b, True), ["tool_name"], ["total_calls", "success_count", "failure_count"], ["last_used"]),
      USAGE)
query("j05_running_counters", lambda b: live.running_counters(b.tool_events, "tool_name", "success", "timestamp"), USAGE)


def hourly(b, new):
    rows = b.tool_events.filter(F.col("timestamp") > HALF if new else F.col("timestamp") <= HALF)
    return up.hourly_delta(rows, day_of("timestamp"), hour_of("timestamp"),
                           F.count_if(F.col("tool_name") == "Write"), F.count(F.lit(1)))


query("b06_hourly_upsert", lambda b: up.upsert_add(
    hourly(b, False), hourly(b, True), ["date", "hour"], ["session_count", "message_count"]), f"""
    SELECT {day('timestamp')} AS date, {hour('timestamp')} AS hour, {cif("tool_name = 'Write'")} AS session_count,
           count(*) AS message_count FROM tool_events GROUP BY 1, 2""")
query("b07_upsert_max", lambda b: up.upsert_max(
    hourly(b, False).select("hour", "message_count"), hourly(b, True).select("hour", "message_count"), ["hour"],
    ["message_count"]), f"""
    SELECT hour, max(n) AS message_count FROM (SELECT {day('timestamp')} AS d, timestamp > {HALF} AS h,
    {hour('timestamp')} AS hour, count(*) AS n FROM tool_events GROUP BY 1, 2, 3) GROUP BY 1""")


def replace(b):
    """Sessions replaced by a second log of half of the columns for some ids."""
    old = b.sessions.select("id", "model", "message_count", "outcome")
    new = b.session_outcome_events.filter(F.col("complexity") > 0.5).select(
        F.col("session_id").alias("id"), F.col("message_count"), F.col("outcome"), F.col("id").alias("seq"))
    return up.upsert_replace(old, new, ["id"], ["seq", "message_count", "outcome"])


query("b05_j10_upsert_replace", replace, """
    WITH n AS (SELECT session_id AS sid, message_count AS mc, outcome AS oc, row_number() OVER (PARTITION BY session_id
               ORDER BY id DESC, message_count DESC, outcome DESC) AS rn FROM session_outcome_events
               WHERE complexity > 0.5),
    w AS (SELECT * FROM n WHERE rn = 1)
    SELECT id, CASE WHEN sid IS NULL THEN model END AS model, coalesce(mc, message_count) AS message_count,
           CASE WHEN sid IS NULL THEN outcome ELSE oc END AS outcome FROM sessions LEFT JOIN w ON sid = id""")


def rated(b):
    fb = b.part.select(F.col("p_partkey").cast("string").alias("query_hash"),
                       F.when(F.col("p_size") > 25, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("verdict"))
    d = newest_per_key(b.routing_decisions.select("id", "timestamp", "query_hash", "success"), ["id"], ["timestamp"])
    return up.rate_latest(d.withColumn("success", F.col("success").cast("bigint")), fb)


query("b08_rate_latest", rated, """
    WITH d AS (SELECT id, timestamp, query_hash, success FROM (SELECT *, row_number() OVER (PARTITION BY id
               ORDER BY timestamp DESC) AS rn FROM routing_decisions) WHERE rn = 1),
    p AS (SELECT id, row_number() OVER (PARTITION BY query_hash ORDER BY timestamp DESC, id DESC) AS rn FROM d
          WHERE success IS NULL)
    SELECT d.id, timestamp, query_hash, CASE WHEN rn = 1 THEN CASE WHEN p_size > 25 THEN 1 ELSE 0 END
           ELSE CAST(success AS BIGINT) END AS success FROM d LEFT JOIN p ON p.id = d.id
    LEFT JOIN part ON query_hash = CAST(p_partkey AS VARCHAR)""")
query("b12_j02_changed_rows", lambda b: pn.changed_rows(
    usage(b, True), pn.with_hash(usage(b, True).withColumn("total_calls", F.when(
        F.col("tool_name") == "Bash", F.lit(-1)).otherwise(F.col("total_calls"))), "tool_name"), "tool_name")
    .drop("row_hash"), f"""
    SELECT tool_name, count(*) AS total_calls, {cif('success = 1')} AS success_count, {cif('success = 0')}
    AS failure_count, max(timestamp) AS last_used FROM tool_events WHERE timestamp > {HALF} AND tool_name = 'Bash'
    GROUP BY 1""")
META = """md AS (SELECT *, CASE WHEN json_valid(metadata) THEN metadata END AS mj FROM sync_events),
    dc AS (SELECT ts, tool, coalesce(file_path, '') AS file_path, session_pwd,
           coalesce(substr(regexp_extract(session_pwd, '([^/]*)$', 1), 1, 8), 'unknown') AS session,
           coalesce(json_extract_string(mj, '$.command'), '') AS command,
           CASE WHEN json_extract_string(mj, '$.success') = 'false' THEN CAST(0 AS BIGINT) ELSE 1 END AS success,
           coalesce(json_extract_string(mj, '$.model'), 'sonnet') AS model,
           coalesce(CAST(json_extract_string(mj, '$.exit_code') AS BIGINT), 0) AS exit_code,
           coalesce(mj, '{}') AS metadata FROM md)"""
NOT_S = "WHERE NOT starts_with(tool, 'session_')"
query("b11_j04_export_session_events", lambda b: ex.session_events(ex.decode(b.sync_events)), f"""
    WITH {META} SELECT ts, tool AS event, session_pwd AS pwd, metadata FROM dc WHERE starts_with(tool, 'session_')""")
query("b11_j04_export_tool_usage", lambda b: ex.tool_usage(ex.decode(b.sync_events)), f"""
    WITH {META} SELECT ts, tool, session, model, 'lake' AS source, file_path, command, success FROM dc {NOT_S}""")
query("b11_j04_export_tool_success", lambda b: ex.tool_success(ex.decode(b.sync_events)), f"""
    WITH {META} SELECT ts, tool, success, exit_code, session FROM dc {NOT_S}""")
query("b11_j04_export_commands", lambda b: ex.command_usage(ex.decode(b.sync_events)), f"""
    WITH {META} SELECT ts, 'git' AS command, substr(command, 1, 200) AS full_command, success, session FROM dc
    WHERE tool = 'Bash' AND command <> ''""")
query("b11_j04_export_activity", lambda b: ex.activity(ex.decode(b.sync_events)), f"""
    WITH {META} SELECT ts, 'tool_use' AS type, tool, file_path, substr(command, 1, 200) AS command, success,
    session_pwd AS pwd FROM dc {NOT_S}""")
query("j06_hourly_windows", lambda b: live.windowed_counts(b.activity_events, "timestamp", "1 hour", ["event_type"]), """
    SELECT timestamp // 3600 * 3600 AS window_start, event_type, count(*) AS n FROM activity_events GROUP BY 1, 2""")
query("j07_session_windows", lambda b: live.stream_sessions(b.tool_events, "timestamp", "2 hours", ["session_id"]).drop(
    "duration_seconds"), """
    WITH o AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w < 7200 THEN 0 ELSE 1 END AS nw FROM tool_events
               WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, id)),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY session_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS g FROM o)
    SELECT session_id, count(*) AS event_count, min(timestamp) AS start_ts, max(timestamp) AS end_ts FROM i
    GROUP BY session_id, g""")
query("j08_active_sessions", lambda b: live.active_sessions(live.last_seen(b.tool_events, "session_id", "timestamp"),
                                                            24 * 60, as_of=1706659200), """
    SELECT count(*) AS active FROM (SELECT session_id, max(timestamp) AS l FROM tool_events GROUP BY 1)
    WHERE l > 1706659200 - 86400""")
LIVE_AT = 1001894400   # 2001-10-01 00:00:00
query("j01_live_snapshot", lambda b: live_snapshot(
    b.daily_stats, b.sessions, b.activity_events, as_of=LIVE_AT, day="2001-10-01"), f"""
    WITH t AS (SELECT {isum('opus_messages + sonnet_messages + haiku_messages')} AS m, {isum('session_count')} AS s,
               {isum('tool_calls')} AS c, {dsum('cost_estimate')} AS v FROM daily_stats),
    d AS (SELECT coalesce(sum(opus_messages + sonnet_messages + haiku_messages), 0) AS m,
          coalesce(sum(session_count), 0) AS s, coalesce(sum(tool_calls), 0) AS c FROM daily_stats
          WHERE date = '2001-10-01'),
    l AS (SELECT id, message_count, tool_count FROM sessions ORDER BY started_at DESC, id LIMIT 1),
    a AS (SELECT {r(f'({LIVE_AT} - max(timestamp)) / 60e0', 1)} AS age FROM activity_events)
    SELECT 'totals' AS section, '' AS key, 'total_messages' AS metric, CAST(m AS DOUBLE) AS value FROM t
    UNION ALL SELECT 'totals', '', 'total_sessions', s FROM t UNION ALL SELECT 'totals', '', 'total_tools', c FROM t
    UNION ALL SELECT 'totals', '', 'total_cost', v FROM t UNION ALL SELECT 'today', '', 'messages', m FROM d
    UNION ALL SELECT 'today', '', 'sessions', s FROM d UNION ALL SELECT 'today', '', 'tools', c FROM d
    UNION ALL SELECT 'sessions', '', 'active', count(*) FROM sessions WHERE ended_at IS NULL OR ended_at > {LIVE_AT - 300}
    UNION ALL SELECT 'latest_session', id, 'message_count', message_count FROM l
    UNION ALL SELECT 'latest_session', id, 'tool_count', tool_count FROM l
    UNION ALL SELECT 'data_age', 'offline', 'age_minutes', age FROM a""")
