"""Tool usage queries."""

from pyspark.sql import functions as F

from tracewell.operators import tools as t
from tracewell.operators.filters import where_equal, within_days
from tracewell.operators.ordering import latest
from tracewell.plans.registry import EVENTS_NOW as NOW
from tracewell.plans.registry import avg, cif, day, hour, isum, pct, query, r

W7 = f"timestamp > {NOW - 7 * 86400}"
W30 = f"timestamp > {NOW - 30 * 86400}"
OK, BAD = cif("success = 1"), cif("success = 0")
KINDS = ", ".join(f"{cif(f'tool_name = {chr(39)}{v}{chr(39)}')} AS {k}" for k, v in t.KINDS.items())
SINCE = 1704067200 - 1   # the first plausible event is on 2024-01-01

query("e14_tool_usage_summary", lambda b: t.usage_summary(b.since(NOW - 7 * 86400).tool_events, as_of=NOW, days=7), f"""
    SELECT tool_name, count(*) AS total_calls, {OK} AS success_count, {BAD} AS failure_count,
           {avg('duration_ms')} AS avg_duration_ms, max(timestamp) AS last_used, {pct(OK, 'count(*)')} AS success_rate
    FROM tool_events WHERE {W7} GROUP BY tool_name""")
query("e15_tool_success_rate", lambda b: t.success_rate(b.since(NOW - 7 * 86400).tool_events, as_of=NOW, days=7), f"""
    SELECT tool_name, count(*) AS total, {pct(OK, 'count(*)')} AS success_rate FROM tool_events WHERE {W7}
    GROUP BY tool_name HAVING count(*) > 5 ORDER BY success_rate, tool_name LIMIT 10""")
query("e16_tool_hourly", lambda b: t.hourly_calls(b.since(NOW - 7 * 86400).tool_events, as_of=NOW, days=7), f"""
    SELECT {hour('timestamp')} AS hour, count(*) AS calls FROM tool_events WHERE {W7} GROUP BY 1""")
query("e17_tool_totals", lambda b: t.totals(b.since(NOW - 7 * 86400).tool_events, as_of=NOW, days=7), f"""
    SELECT count(*) AS total_events, count(DISTINCT tool_name) AS unique_tools,
           {pct(OK, 'count(*)')} AS overall_success_rate, {r(avg('duration_ms'), 1)} AS avg_duration
    FROM tool_events WHERE {W7}""")
query("e18_tool_kind_totals", lambda b: t.kind_totals(b.tool_events),
      f"SELECT count(*) AS total, {KINDS} FROM tool_events")
query("e18_calls_by_tool", lambda b: t.calls_by_tool(b.tool_events),
      "SELECT tool_name, count(*) AS calls FROM tool_events GROUP BY 1")
query("e19_tool_daily_kinds", lambda b: t.daily_kinds(b.tool_events, since=SINCE, end="2024-02-02"), f"""
    WITH d AS (SELECT {day('timestamp')} AS date, count(*) AS total, {KINDS} FROM tool_events
               WHERE timestamp > {SINCE} GROUP BY 1),
    spine AS (SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS date FROM generate_series(
               (SELECT min(CAST(date AS DATE)) FROM d), DATE '2024-02-02', INTERVAL 1 DAY) g(x))
    SELECT date, coalesce(total, 0) AS total, {', '.join(f'coalesce({k}, 0) AS {k}' for k in t.KINDS)}
    FROM spine LEFT JOIN d USING (date)""")
query("e20_tool_top", lambda b: t.calls_by_tool(b.tool_events, 20),
      "SELECT tool_name, count(*) AS calls FROM tool_events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
query("e20_tool_overview", lambda b: t.overview(b.tool_events), f"""
    SELECT count(*) AS total, {BAD} AS failures, coalesce({pct(OK, 'count(*)')}, 1e2) AS success_rate
    FROM tool_events""")
query("e21_failure_patterns", lambda b: t.failure_patterns(b.since(NOW - 30 * 86400).tool_events, as_of=NOW, days=30), f"""
    SELECT tool_name, {day('timestamp')} AS date, count(*) AS failures,
           coalesce(min(error_message), 'Unknown error') AS error
    FROM tool_events WHERE success = 0 AND {W30} GROUP BY 1, 2 ORDER BY failures DESC, date DESC, tool_name
    LIMIT 20""")
query("e22_log_tool_success", lambda b: t.log_success(b.tool_log), f"""
    SELECT coalesce(tool, 'unknown') AS tool, count(*) AS total, {pct(OK, 'count(*)')} AS rate
    FROM tool_log GROUP BY 1 ORDER BY total DESC, 1 LIMIT 20""")
query("e22_log_tool_success_overall", lambda b: t.log_success_overall(b.tool_log), f"""
    SELECT count(*) AS total, {OK} AS success, coalesce({pct(OK, 'count(*)')}, 0e0) AS overall_success_rate
    FROM tool_log""")
query("e23_log_tool_usage", lambda b: t.log_usage(b.tool_log), """
    (SELECT 'tool' AS dimension, coalesce(tool, 'unknown') AS value, count(*) AS calls FROM tool_log GROUP BY 2
     ORDER BY 3 DESC, 2 LIMIT 20)
    UNION ALL (SELECT 'model', coalesce(model, 'unknown'), count(*) FROM tool_log GROUP BY 2)""")
query("e24_tool_category_mix", lambda b: t.category_mix(b.tool_events), f"""
    WITH c AS (SELECT CASE WHEN tool_name IN ('Bash', 'Read', 'Edit', 'Write') THEN 'core'
                           WHEN tool_name IN ('Grep', 'Glob') THEN 'search' ELSE 'advanced' END AS category
               FROM tool_events),
    n AS (SELECT x AS category, (SELECT count(*) FROM c WHERE c.category = x) AS calls
          FROM (VALUES ('core'), ('search'), ('advanced')) v(x))
    SELECT category, calls, {pct('calls', '(SELECT count(*) FROM c)')} AS pct FROM n""")
query("e25_unweighted_success", lambda b: t.unweighted_success(b.tool_events), f"""
    SELECT {avg('rt')} AS success_rate FROM
    (SELECT {pct(OK, 'count(*)')} AS rt FROM tool_events GROUP BY tool_name)""")
query("e26_calls_per_active_day", lambda b: t.per_active_day(
    t.daily_kinds(b.tool_events, since=SINCE, end="2024-02-02"), "total"), f"""
    WITH d AS (SELECT {day('timestamp')} AS date, count(*) AS n FROM tool_events GROUP BY 1)
    SELECT {isum('n')} AS total, {cif('n > 0')} AS active_days, {r(f"sum(n) / {cif('n > 0')}")} AS avg_daily FROM d""")
query("e27_command_weights", lambda b: t.command_weights(b.command_log), f"""
    SELECT coalesce(nullif(cmd, ''), command, 'unknown') AS command, {isum('coalesce(count, 1)')} AS uses
    FROM command_log GROUP BY 1 ORDER BY uses DESC, 1 LIMIT 15""")
query("e28_tool_summary", lambda b: t.tool_summary(b.tool_events), """
    WITH c AS (SELECT tool_name, count(*) AS calls FROM tool_events GROUP BY 1)
    SELECT tool_name, calls, (SELECT count(*) FROM tool_events) AS total_calls,
           (SELECT count(*) FROM c) AS unique_tools FROM c ORDER BY calls DESC, tool_name LIMIT 20""")
query("l21_productivity", lambda b: t.productivity(b.tool_events), f"""
    WITH k AS (SELECT count(*) AS total, {KINDS} FROM tool_events),
    s AS (SELECT total, reads, edits + writes AS w, (edits + writes) / (reads + edits + writes) AS share FROM k)
    SELECT total, reads, w AS write_ops, share AS write_share,
           CASE WHEN share > 0.4 THEN 'High Output' WHEN share > 0.25 THEN 'Balanced' WHEN share > 0.1
                THEN 'Research Heavy' ELSE 'Exploration' END AS mode,
           CASE WHEN reads = 0 AND w = 0 THEN 'No activity' WHEN reads / greatest(w, 1) > 100
                THEN 'Read-heavy (exploration mode)' WHEN reads / greatest(w, 1) > 20 THEN 'Learning/researching'
                WHEN reads / greatest(w, 1) > 10 THEN 'Balanced productivity' ELSE 'High productivity mode' END
                AS ratio_mode, {pct('w', 'total')} AS write_intensity FROM s""")
query("l21_daily_productivity", lambda b: t.daily_productivity(t.daily_kinds(b.tool_events, since=SINCE)), f"""
    SELECT {day('timestamp')} AS date, CAST({cif("tool_name IN ('Edit', 'Write')")} AS DOUBLE) /
           nullif({cif("tool_name IN ('Edit', 'Write', 'Read')")}, 0) AS score FROM tool_events GROUP BY 1""")
query("c01_c03_tool_events_window", lambda b: latest(
    where_equal(within_days(b.since(NOW - 7 * 86400).tool_events, "timestamp", 7, as_of=NOW), tool_name="Edit"), "timestamp", 100), f"""
    SELECT * FROM tool_events WHERE {W7} AND tool_name = 'Edit' ORDER BY timestamp DESC, id DESC LIMIT 100""")
query("t14_weighted_success", lambda b: t.weighted_success(
    b.tool_events.groupBy("tool_name").agg(F.count_if(F.col("success") == 1).alias("success_count"),
                                           F.count_if(F.col("success") == 0).alias("failure_count"))),
      f"SELECT {pct(OK, 'count(*)')} AS success_rate FROM tool_events")
