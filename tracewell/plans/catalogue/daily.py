"""Daily rollups, views and cost."""

from pyspark.sql import functions as F

from tracewell.functions.exprs import day_of
from tracewell.operators import daily as d
from tracewell.operators import health
from tracewell.operators import transcripts as tr
from tracewell.plans.registry import EVENTS_NOW, LINES_DAY, avg, day, dbl, dec, dsum, isum, pct, query, r

T = ("opus", "sonnet", "haiku")
X = ("messages", "tokens_in", "tokens_out", "cache_read")
P = {"opus": (5, 25, 0.5), "sonnet": (3, 15, 0.3), "haiku": (1, 5, 0.1)}
MSGS = "(opus_messages + sonnet_messages + haiku_messages)"


def s(x):
    return "(" + " + ".join(f"{m}_{x}" for m in T) + ")"


def cost_of(m):
    a, b, c = P[m]
    return f"(({m}_tokens_in * {a}e0 + {m}_tokens_out * {b}e0 + {m}_cache_read * {c}e0) / 1e6)"


COST = "(" + " + ".join(cost_of(m) for m in T) + ")"
SUMS = "sums AS (SELECT " + ", ".join(f"{isum(f'{m}_{x}')} AS {m}_{x}" for m in T for x in X) + \
    ", min(date) AS first_date, count(*) AS n_days FROM daily_stats), " + \
    f"v AS (SELECT *, {r(COST, 6)} AS total_value, {MSGS} AS total_messages FROM sums)"

query("e01_totals", lambda b: d.totals(b.daily_stats), f"""
    SELECT {isum(MSGS)} AS total_messages, {isum('session_count')} AS total_sessions, {isum('tool_calls')} AS total_tools,
           {', '.join(f"{isum(f'{m}_messages')} AS {m}_messages" for m in T)},
           {dsum('cost_estimate')} AS total_cost FROM daily_stats""")
LONG = " UNION ALL ".join(
    f"SELECT date, '{m}' AS model, " + ", ".join(f"{m}_{x} AS {x}" for x in X) + " FROM daily_stats" for m in T)
query("e02_tokens_by_model", lambda b: d.by_model_tokens(b.daily_long), f"""
    SELECT model, {', '.join(f'{isum(x)} AS {x}' for x in X)} FROM ({LONG}) GROUP BY model""")
query("e03_hour_pattern_sessions", lambda b: d.hour_pattern(b.hourly_activity),
      f"SELECT hour, {isum('session_count')} AS total FROM hourly_activity GROUP BY hour")
query("e04_hour_pattern_all", lambda b: d.hour_pattern(b.hourly_activity, include_messages=True),
      f"SELECT hour, {isum('session_count + message_count')} AS total FROM hourly_activity GROUP BY hour")
query("e05_daily_series", lambda b: d.daily_series(b.daily_stats),
      f"SELECT date, {MSGS} AS message_count, session_count, tool_calls FROM daily_stats")
query("e06_daily_model_tokens", lambda b: d.daily_tokens(b.daily_stats), f"""
    SELECT date, {', '.join(f'{m}_tokens_in + {m}_tokens_out + {m}_cache_read AS {m}_total' for m in T)},
           {', '.join(f'{m}_{x}' for m in T for x in X[1:])} FROM daily_stats""")
query("e07_stats_bundle", lambda b: d.metric_rows(
    {k: v for k, v in d.stats_bundle(b.daily_stats, b.hourly_activity, b.sessions).items()
     if k in ("totals", "model_usage", "hour_counts", "longest_session")},
    {"model_usage": "model", "hour_counts": "hour", "longest_session": "session_id"}), f"""
    WITH t AS (SELECT {isum(MSGS)} AS total_messages, {isum('session_count')} AS total_sessions,
               {isum('tool_calls')} AS total_tools, {', '.join(f"{isum(f'{m}_messages')} AS {m}_messages" for m in T)},
               {dsum('cost_estimate')} AS total_cost FROM daily_stats),
    m AS (SELECT model, {', '.join(f'{isum(x)} AS {x}' for x in X)} FROM ({LONG}) GROUP BY model),
    h AS (SELECT hour, {isum('session_count + message_count')} AS total FROM hourly_activity GROUP BY hour),
    l AS (SELECT substr(id, 1, 20) AS sid, message_count FROM sessions ORDER BY message_count DESC, id LIMIT 1)
    {' UNION ALL '.join(f"SELECT 'totals' AS section, '' AS key, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM t"
                        for c in ['total_messages', 'total_sessions', 'total_tools', 'opus_messages',
                                  'sonnet_messages', 'haiku_messages', 'total_cost'])}
    UNION ALL {' UNION ALL '.join(f"SELECT 'model_usage', model, '{x}', CAST({x} AS DOUBLE) FROM m" for x in X)}
    UNION ALL SELECT 'hour_counts', CAST(hour AS VARCHAR), 'total', CAST(total AS DOUBLE) FROM h
    UNION ALL SELECT 'longest_session', sid, 'message_count', CAST(message_count AS DOUBLE) FROM l""")
query("c02_recent_daily_stats", lambda b: d.recent_daily(b.daily_stats, 30, as_of=LINES_DAY), """
    SELECT * FROM daily_stats WHERE date >= '2001-10-02'""")
query("e11_daily_model_rollup", lambda b: d.model_tokens(b.sessions, day_of("started_at")), f"""
    SELECT {day('started_at')} AS date, CASE WHEN model LIKE '%opus%' THEN 'opus' WHEN model LIKE '%sonnet%'
           THEN 'sonnet' WHEN model LIKE '%haiku%' THEN 'haiku' ELSE 'opus' END AS model,
           {isum('message_count')} AS messages, {isum('input_tokens')} AS tokens_in,
           {isum('output_tokens')} AS tokens_out, {isum('cache_read_tokens')} AS cache_read
    FROM sessions GROUP BY 1, 2""")


def _activity(b):
    """Daily activity of sessions plus days of events that carry no tokens."""
    s = b.sessions.groupBy(day_of("started_at").alias("date")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("message_count").alias("messages"),
        F.sum("tool_count").alias("tools"))
    e = b.tool_events.groupBy(day_of("timestamp").alias("date")).agg(
        F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("messages"),
        F.count(F.lit(1)).alias("tools"))
    return s.unionByName(e)


_TIER = ("CASE WHEN model LIKE '%opus%' THEN 'opus' WHEN model LIKE '%sonnet%' THEN 'sonnet' "
         "WHEN model LIKE '%haiku%' THEN 'haiku' ELSE 'opus' END")
query("d10_daily_stats_build", lambda b: d.to_daily_stats(
    _activity(b), d.model_tokens(b.sessions, day_of("started_at")),
    b.turns.filter("model is not null").groupBy(F.regexp_extract("model", r"x-(\w+)-", 1).alias("model")).agg(
        F.count(F.lit(1)).alias("n"))).withColumn("cost_estimate", d.rnd("cost_estimate", 6)), f"""
    WITH a AS (SELECT {day('started_at')} AS date, count(*) AS sessions, {isum('message_count')} AS messages,
                      {isum('tool_count')} AS tools FROM sessions GROUP BY 1
               UNION ALL SELECT {day('timestamp')}, count(DISTINCT session_id), count(*), count(*) FROM tool_events
               GROUP BY 1),
    k AS (SELECT {day('started_at')} AS date, {', '.join(
        f"CAST(coalesce(sum({c}) FILTER (WHERE {_TIER} = '{m}'), 0) AS BIGINT) AS {m}_{x}" for m in T for x, c in zip(
            X, ('message_count', 'input_tokens', 'output_tokens', 'cache_read_tokens')))} FROM sessions GROUP BY 1),
    w AS (SELECT count(*) FILTER (WHERE model LIKE '%opus%') > count(*) FILTER (WHERE model LIKE '%sonnet%') AS lead
          FROM turns),
    j AS (SELECT a.date, a.sessions AS session_count, a.tools AS tool_calls,
                 CASE WHEN k.date IS NOT NULL THEN opus_messages WHEN (SELECT lead FROM w) THEN messages ELSE 0 END
                      AS opus_messages,
                 CASE WHEN k.date IS NOT NULL THEN sonnet_messages WHEN NOT (SELECT lead FROM w) THEN messages ELSE 0
                      END AS sonnet_messages, coalesce(haiku_messages, 0) AS haiku_messages,
                 {', '.join(f'coalesce({m}_{x}, 0) AS {m}_{x}' for m in T for x in X[1:])}
          FROM a LEFT JOIN k ON a.date = k.date)
    SELECT *, {r(COST, 6)} AS cost_estimate FROM j""")
query("d07_e12_activity_timeline", lambda b: d.activity_timeline(b.daily_stats, b.git_events.groupBy(
    day_of("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("commits"))), f"""
    SELECT date, tool_calls AS tools, session_count AS sessions, {MSGS} AS messages, coalesce(commits, 0) AS commits
    FROM daily_stats LEFT JOIN (SELECT {day('timestamp')} AS date, count(*) AS commits FROM git_events GROUP BY 1)
    USING (date)""")
query("e92_view_daily_costs", lambda b: d.view_daily_costs(b.daily_stats), f"""
    SELECT date, {r('opus_tokens_in * 5e0 / 1e6 + opus_tokens_out * 25e0 / 1e6 + (sonnet_tokens_in * 3e0 / 1e6 + '
                    'sonnet_tokens_out * 15e0 / 1e6) + (haiku_tokens_in * 0.8e0 / 1e6 + haiku_tokens_out * 4e0 / 1e6)',
                    6)} AS api_cost,
           {r(f"{s('cache_read')} * 0.5e0 / 1e6", 6)} AS cache_savings, {MSGS} AS total_messages, session_count
    FROM daily_stats""")
query("e92_view_model_distribution", lambda b: d.view_model_distribution(b.daily_stats), f"""
    WITH t AS (SELECT {', '.join(f"{isum(f'{m}_messages')} AS {m}_total" for m in T)}, {isum(MSGS)} AS grand_total
               FROM daily_stats)
    SELECT *, {', '.join(f"{pct(f'{m}_total', 'grand_total')} AS {m}_pct" for m in T)} FROM t""")
query("e92_view_token_totals", lambda b: d.view_token_totals(b.daily_stats), f"""
    WITH t AS (SELECT {isum(s('cache_read'))} AS c, {isum(s('tokens_in'))} AS i, {isum(s('tokens_out'))} AS o
               FROM daily_stats)
    SELECT c AS total_cache_read, i AS total_input, {pct('c', '(c + i + o)')} AS cache_efficiency FROM t""")
query("e92_view_subscription", lambda b: d.view_subscription(b.daily_stats, as_of=LINES_DAY), f"""
    WITH t AS (SELECT {isum(MSGS)} AS total_messages, {isum('session_count')} AS total_sessions,
               {dsum('cost_estimate')} AS total_value, min(date) AS f FROM daily_stats)
    SELECT total_messages, total_sessions, total_value,
           {r("total_value / (greatest(1e0, date_diff('day', CAST(f AS DATE), DATE '2001-11-01') / 30e0) * 200e0)", 1)}
           AS roi_multiplier FROM t""")
query("l01_model_costs", lambda b: d.model_costs(b.daily_long), f"""
    WITH t AS (SELECT model, {', '.join(f'{isum(x)} AS {x}' for x in X)} FROM ({LONG}) GROUP BY model),
    p AS (SELECT * FROM (VALUES ('opus', 5e0, 25e0, 0.5e0), ('sonnet', 3e0, 15e0, 0.3e0), ('haiku', 1e0, 5e0, 0.1e0))
          v(m, a, o, c))
    SELECT model, messages, tokens_in, tokens_out, cache_read,
           {r('(tokens_in * a + tokens_out * o + cache_read * c) / 1e6', 6)} AS cost,
           {r('cache_read * (a - c) / 1e6', 6)} AS cache_saving FROM t JOIN p ON model = m""")
MONTHS = {
    "calendar": "greatest(date_diff('day', CAST(first_date AS DATE), DATE '2001-11-01') / 30e0, 1e0)",
    "active_rows": "greatest(n_days / 30e0, 1e0)",
    "day_rate": f"greatest(n_days * {200.0 / 30.0!r}e0, 1e0) / 200e0",
    "one_month": "1e0",
}
for _v, _m in MONTHS.items():
    query(f"l02_roi_{_v}", lambda b, v=_v: d.roi(b.daily_stats, v, as_of=LINES_DAY), f"""
        WITH {SUMS}, p AS (SELECT *, {_m} AS months, {_m} * 200e0 AS paid FROM v)
        SELECT '{_v}' AS variant, {r('total_value', 2)} AS total_value, {r('paid', 2)} AS paid,
               {r('total_value / paid', 1)} AS multiplier, {r('total_value - paid', 2)} AS savings,
               {r('months', 1)} AS months, CASE WHEN total_messages > 100 THEN 'high' ELSE 'normal' END AS utilization,
               {r('total_value / greatest(total_messages, 1)', 4)} AS cost_per_message FROM p""")
query("l03_cache_savings", lambda b: d.cache_savings(b.daily_stats), f"""
    WITH {SUMS}, p AS (SELECT *, greatest(n_days / 30e0, 1e0) * 200e0 AS paid, {s('cache_read')} AS cr,
                              {s('tokens_in')} AS ti FROM v)
    SELECT {r('cr / greatest(cr + ti, 1) * 100', 1)} AS efficiency, {r('cr * 0.5e0 / 1e6', 2)} AS flat_saving,
           CASE WHEN total_value > paid THEN {r('total_value - paid', 2)} ELSE 0e0 END AS value_above_subscription,
           {r('(opus_cache_read * 4.5e0 + sonnet_cache_read * 2.7e0 + haiku_cache_read * 0.9e0) / 1e6', 2)}
           AS price_gap_saving FROM p""")
DC = f"c AS (SELECT date, {r(COST, 2)} AS cost FROM daily_stats)"
query("e91_cost_daily", lambda b: d.cost_daily(b.daily_stats), f"WITH {DC} SELECT * FROM c")
query("f09_cost_windows", lambda b: d.cost_windows(b.daily_stats), f"""
    WITH {DC}, k AS (SELECT cost, row_number() OVER (ORDER BY date DESC) AS n FROM c)
    SELECT {r('sum(cost) FILTER (WHERE n <= 1)', 2)} AS today, {r('sum(cost) FILTER (WHERE n <= 7)', 2)} AS week,
           {r('sum(cost) FILTER (WHERE n <= 30)', 2)} AS month FROM k""")
query("f10_cumulative_roi", lambda b: d.cumulative_roi(b.daily_stats), f"""
    SELECT date, {r(f'sum({COST}) OVER (ORDER BY date)')} AS api,
           {r(f'row_number() OVER (ORDER BY date) * {200.0 / 30.0!r}e0')} AS sub FROM daily_stats""")

# ---- transcripts -----------------------------------------------------------

FOLD = f"""
    tt AS (SELECT *, CASE WHEN model LIKE '%opus%' THEN 'opus' WHEN model LIKE '%sonnet%' THEN 'sonnet'
                     WHEN model LIKE '%haiku%' THEN 'haiku' END AS tier FROM turns),
    ff AS (SELECT session_id, arg_min({day('timestamp')}, turn) AS date, {"count(*) FILTER (WHERE type IN ('user', 'assistant'))"} AS messages,
           CAST(coalesce(sum(tools) FILTER (WHERE type = 'assistant'), 0) AS BIGINT) AS tools,
           count(*) FILTER (WHERE type = 'assistant' AND tier = 'opus') AS opus,
           count(*) FILTER (WHERE type = 'assistant' AND tier = 'sonnet') AS sonnet,
           count(*) FILTER (WHERE type = 'assistant' AND tier = 'haiku') AS haiku,
           arg_min(substr(text, 1, 100), turn) FILTER (WHERE type = 'user' AND length(text) > 3) AS first_text,
           coalesce(bool_or(type = 'assistant' AND stop_reason = 'error'), false) AS bad FROM tt GROUP BY 1),
    ss AS (SELECT *, CASE WHEN bad THEN 'error' WHEN messages < 5 THEN 'abandoned' WHEN tools > 10 OR messages > 20
                     THEN 'success' ELSE 'partial' END AS outcome,
           {r('(haiku * 1e0 + sonnet * 0.8e0 + opus * 0.5e0) / greatest(opus + sonnet + haiku, 1)', 2)} AS eff,
           {r('least(5e0, greatest(1e0, 1e0 + least(2.5e0, messages / 1e2) + least(2.5e0, tools / 5e1)))', 1)} AS q
           FROM ff)"""


def folded(b):
    return tr.score_sessions(tr.fold_sessions(b.turns))


query("e08_l04_l05_l06_transcript_sessions", lambda b: folded(b).select(
    "session_id", "date", "messages", "tools", F.array_join(F.transform("hours", lambda h: h.cast("string")), ",")
    .alias("hours"), "opus", "sonnet", "haiku", "title", "intent", "outcome", "model_efficiency", "quality",
    "primary_model"), f"""
    WITH {FOLD}, hh AS (SELECT session_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS hours FROM
                        (SELECT DISTINCT session_id, (timestamp // 3600) % 24 AS h FROM turns) GROUP BY 1)
    SELECT session_id, date, messages, tools, hours, opus, sonnet, haiku, substr(first_text, 1, 50) AS title,
           substr(first_text, 1, 80) AS intent, outcome, eff AS model_efficiency, q AS quality,
           CASE WHEN opus >= sonnet AND opus >= haiku THEN 'opus' WHEN sonnet >= haiku THEN 'sonnet' ELSE 'haiku' END
           AS primary_model FROM ss JOIN hh USING (session_id)""")
query("e09_sessions_to_daily", lambda b: tr.sessions_to_daily(folded(b)), f"""
    WITH {FOLD} SELECT date, count(*) AS sessions, {isum('messages')} AS messages, {isum('tools')} AS tools,
    {', '.join(f'{isum(m)} AS {m}' for m in T)} FROM ss GROUP BY date""")
query("e09_hour_presence", lambda b: tr.hour_presence(folded(b)), """
    SELECT h AS hour, count(*) AS sessions FROM
    (SELECT DISTINCT session_id, (timestamp // 3600) % 24 AS h FROM turns) GROUP BY 1""")
USAGE = """u AS (SELECT CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input, CAST(sum(output_tokens) AS BIGINT)
           AS output, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read, CAST(sum(cache_create_tokens) AS BIGINT)
           AS cache_create FROM turns WHERE type = 'assistant')"""
query("e10_usage_totals", lambda b: tr.usage_totals(b.turns), f"WITH {USAGE} SELECT * FROM u")
query("e100_cache_hit_rate", lambda b: tr.cache_hit_rate(tr.usage_totals(b.turns)), f"""
    WITH {USAGE}, x AS (SELECT CAST(cache_read AS DOUBLE) / (cache_read + input + cache_create) AS v FROM u)
    SELECT {r('v', 4)} AS cache_hit_rate, {r('v * 100', 2)} AS reduction_pct FROM x""")
_STORED = "CASE WHEN CAST(substr(date, 9, 2) AS BIGINT) % 2 = 0 THEN 10.5e0 ELSE 0e0 END"
query("d09_e100_pack_savings", lambda b: tr.pack_savings(
    tr.sessions_to_daily(folded(b)), tr.sessions_to_daily(folded(b)).select(
        "date", F.expr("CASE WHEN CAST(substr(date, 9, 2) AS BIGINT) % 2 = 0 THEN 10.5D ELSE 0D END")
        .alias("cost_estimate"))), f"""
    WITH {FOLD}, dd AS (SELECT date, count(*) AS sessions, {isum('messages')} AS messages,
                        {', '.join(f'{isum(m)} AS {m}' for m in T)} FROM ss GROUP BY date)
    SELECT date, sessions, messages, messages * 1500 AS token_savings,
           {r(f'CASE WHEN {_STORED} = 0 AND messages > 0 THEN opus * 0.12e0 + sonnet * 0.05e0 + haiku * 0.01e0 '
              f'ELSE {_STORED} END', 2)} AS cost_savings FROM dd""")
query("e104_model_message_costs", lambda b: tr.model_message_costs(folded(b)), f"""
    WITH {FOLD} {' UNION ALL '.join(
        f"SELECT '{m}' AS model, {isum(m)} AS messages, {r(f'sum({m}) * {p}e0', 2)} AS cost FROM ss"
        for m, p in tr.COST_PER_MESSAGE.items())}""")
query("l29_value_estimate", lambda b: tr.value_estimate(folded(b)), f"""
    WITH {FOLD}, c AS ({' UNION ALL '.join(
        f"SELECT {isum(m)} AS messages, {r(f'sum({m}) * {p}e0', 2)} AS cost FROM ss"
        for m, p in tr.COST_PER_MESSAGE.items())})
    SELECT {r('sum(cost)', 2)} AS total_value, {isum('messages')} AS total_queries,
           {r('sum(cost) / 200e0', 1)} AS roi_multiplier FROM c""")
query("e38_outcome_tally", lambda b: tr.outcome_tally(folded(b)),
      f"WITH {FOLD} SELECT outcome, count(*) AS n FROM ss GROUP BY 1")
query("a11_outcome_events_from_sessions", lambda b: tr.outcome_events(folded(b)), f"""
    WITH {FOLD} SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS BIGINT) * 86400 AS timestamp,
    session_id, outcome, q AS quality_score, eff AS complexity, CASE WHEN opus >= sonnet AND opus >= haiku THEN 'opus'
    WHEN sonnet >= haiku THEN 'sonnet' ELSE 'haiku' END AS model_used, 0e0 AS cost, messages AS message_count
    FROM ss""")
query("d08_preserve_quality", lambda b: tr.keep_quality(
    folded(b).select("session_id", "quality"),
    b.turns.filter("turn = 1").select("session_id", F.expr(
        "CASE WHEN tools > 4 THEN 4.5D WHEN tools > 2 THEN 0D END").alias("quality"))), f"""
    WITH {FOLD}, st AS (SELECT session_id, CASE WHEN tools > 4 THEN 4.5e0 WHEN tools > 2 THEN 0e0 END AS quality
                        FROM turns WHERE turn = 1)
    SELECT ss.session_id, CASE WHEN st.quality > 0 THEN st.quality ELSE q END AS quality
    FROM ss LEFT JOIN st USING (session_id)""")
query("e93_spend_baseline", lambda b: health.spend_baseline(
    b.cost_tracking, as_of=EVENTS_NOW - 3600), f"""
    WITH c AS (SELECT {day('ts')} AS d, {dsum('cost_usd')} AS c FROM cost_tracking GROUP BY 1)
    SELECT {avg('c')} AS baseline, coalesce({dbl(f"sum({dec('c')}) FILTER (WHERE d = '2024-01-30')")}, 0e0) AS today FROM c""")
