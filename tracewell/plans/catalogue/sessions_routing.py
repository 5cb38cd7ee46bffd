"""Sessions, outcomes, routing, expertise and predictions."""

from pyspark.sql import functions as F

from tracewell.functions.exprs import hour_of
from tracewell.operators import filters as fl
from tracewell.operators import routing as rt
from tracewell.operators import sessions as s
from tracewell.operators.ordering import latest
from tracewell.operators.windows import current_rank
from tracewell.plans.registry import EVENTS_NOW, LINES_NOW, avg, cif, day, dbl, dec, dsum, hour, isum, pct, query, r

L60 = LINES_NOW - 60 * 86400
L365 = LINES_NOW - 365 * 86400
T = ("opus", "sonnet", "haiku")


def out(o):
    return cif(f"outcome = '{o}'")


query("e29_outcome_counts", lambda b: s.outcome_counts(b.sessions),
      "SELECT outcome, count(*) AS n FROM sessions WHERE outcome IS NOT NULL GROUP BY 1")
query("e30_outcome_totals", lambda b: s.outcome_totals(b.sessions), f"""
    SELECT count(*) AS total, {out('success')} AS success, {out('abandoned')} AS abandoned, {out('partial')} AS partial,
           {out('error')} AS error, {cif("outcome NOT IN ('success', 'abandoned', 'partial', 'error')")} AS other,
           {r(avg('message_count'), 1)} AS avg_messages, {isum('message_count')} AS total_messages,
           {isum('tool_count')} AS total_tools, {cif('message_count = 0')} AS empty,
           {cif('message_count > 100')} AS marathon FROM sessions""")
query("e31_quality_histogram", lambda b: s.quality_hist(b.session_outcome_events), """
    SELECT CAST(floor(quality_score + 0.5e0) AS BIGINT) AS quality, count(*) AS n FROM session_outcome_events
    WHERE quality_score > 0 GROUP BY 1""")
query("e32_outcome_by_model", lambda b: s.outcome_by_model(b.sessions), f"""
    SELECT coalesce(model, 'opus') AS model, {out('success')} AS success, {out('abandoned')} AS abandoned,
           {out('partial')} AS partial, count(*) AS total, {pct(out('success'), 'count(*)')} AS success_rate
    FROM sessions GROUP BY 1""")
query("e33_size_buckets", lambda b: s.size_buckets(b.sessions), """
    SELECT CASE WHEN message_count = 0 THEN 'empty' WHEN message_count <= 5 THEN 'tiny' WHEN message_count <= 20
           THEN 'small' WHEN message_count <= 50 THEN 'medium' WHEN message_count <= 100 THEN 'large'
           ELSE 'marathon' END AS size, count(*) AS n FROM sessions GROUP BY 1""")
DAILY = f"""
    SELECT {day('started_at')} AS date, count(*) AS sessions, {out('success').replace('outcome', 's.outcome')} AS success,
           {out('abandoned').replace('outcome', 's.outcome')} AS abandoned, {isum('s.message_count')} AS messages,
           coalesce({avg('o.quality_score')}, 0e0) AS avg_quality, {', '.join(f"{cif(f'model = {chr(39)}{m}{chr(39)}')} AS {m}" for m in T)}
    FROM sessions s LEFT JOIN session_outcome_events o ON o.session_id = s.id GROUP BY 1"""
query("e34_t01_outcome_daily", lambda b: s.outcome_daily(b.sessions, b.session_outcome_events), DAILY)
query("e34_outcome_daily_dedupe", lambda b: s.outcome_daily(b.sessions, b.session_outcome_events, dedupe=True), f"""
    WITH o AS (SELECT session_id, sum({dec('quality_score')}) AS q, count(*) AS k FROM session_outcome_events GROUP BY 1)
    SELECT {day('started_at')} AS date, count(*) AS sessions, {out('success')} AS success,
           {out('abandoned')} AS abandoned, {isum('message_count')} AS messages,
           coalesce({dbl('sum(q)')} / sum(k), 0e0) AS avg_quality,
           {', '.join(f"{cif(f'model = {chr(39)}{m}{chr(39)}')} AS {m}" for m in T)}
    FROM sessions LEFT JOIN o ON session_id = id GROUP BY 1""")
query("e35_daily_success_rate", lambda b: s.daily_success_rate(s.outcome_daily(b.sessions, b.session_outcome_events)),
      f"SELECT date, {pct('success', 'sessions')} AS success_pct FROM ({DAILY})")
query("e36_session_count", lambda b: s.session_count(b.since(L60).session_outcome_events, as_of=LINES_NOW, days=60),
      f"SELECT count(DISTINCT session_id) AS sessions FROM session_outcome_events WHERE timestamp > {L60}")
query("e37_window_averages", lambda b: s.averages(
    b.since(L60).session_outcome_events, b.since(L60).routing_events, as_of=LINES_NOW, days=60), f"""
    SELECT 'quality_score' AS metric, {avg('quality_score')} AS value FROM session_outcome_events
    WHERE timestamp > {L60}
    UNION ALL SELECT 'dq_score', {avg('dq_score')} FROM routing_events WHERE timestamp > {L60}
    UNION ALL SELECT 'complexity', {avg('complexity')} FROM routing_events WHERE timestamp > {L60}""")
query("e39_recent_sessions", lambda b: s.recent_sessions(b.sessions), f"""
    SELECT id, project_path, started_at, model, message_count, outcome, cost_estimate,
           {r('(ended_at - started_at) / 60e0', 1)} AS duration_minutes
    FROM sessions ORDER BY started_at DESC, id LIMIT 100""")
query("d01_l07_recent_with_outcomes", lambda b: s.recent_with_outcomes(b.sessions, b.session_outcome_events), f"""
    SELECT id AS session_id, {day('started_at')} AS date, coalesce(s.message_count, 0) AS messages,
           coalesce(tool_count, 0) AS tools, coalesce(s.outcome, 'unknown') AS outcome,
           CASE WHEN coalesce(quality_score, 0) <> 0 THEN quality_score ELSE least(5e0, greatest(1e0,
                (CASE WHEN coalesce(s.message_count, 0) = 0 THEN 50 ELSE s.message_count END) / 50e0)) END AS quality,
           CASE WHEN coalesce(o.complexity, 0) <> 0 THEN o.complexity ELSE least(1e0,
                (CASE WHEN coalesce(tool_count, 0) = 0 THEN 10 ELSE tool_count END) / 100e0) END AS complexity,
           coalesce(model, 'opus') AS model
    FROM (SELECT * FROM sessions) s
    LEFT JOIN (SELECT session_id AS sid, quality_score, complexity FROM session_outcome_events) o ON sid = id
    ORDER BY started_at DESC, id, quality_score NULLS FIRST, complexity NULLS FIRST LIMIT 50""")
query("f14_longest_session", lambda b: s.longest(b.sessions), f"""
    SELECT substr(id, 1, 20) AS session_id, {day('started_at')} AS date, message_count FROM sessions
    ORDER BY message_count DESC, id LIMIT 1""")
query("e13_dashboard_summary", lambda b: s.dashboard_summary(
    b.since(EVENTS_NOW - 7 * 86400).tool_events, b.since(EVENTS_NOW - 7 * 86400).activity_events,
    b.since(L60).routing_events, b.since(L60).session_outcome_events, tools_as_of=EVENTS_NOW,
    lines_as_of=LINES_NOW, days=7, line_days=60), f"""
    WITH t AS (SELECT * FROM tool_events WHERE timestamp > {EVENTS_NOW - 7 * 86400}),
    a AS (SELECT * FROM activity_events WHERE timestamp > {EVENTS_NOW - 7 * 86400}),
    ro AS (SELECT * FROM routing_events WHERE timestamp > {L60}),
    so AS (SELECT * FROM session_outcome_events WHERE timestamp > {L60})
    SELECT 'tool_stats' AS section, '' AS key, 'unique_tools' AS metric, CAST(count(DISTINCT tool_name) AS DOUBLE) AS value FROM t
    UNION ALL SELECT 'tool_stats', '', 'total_tool_calls', count(*) FROM t
    UNION ALL SELECT 'tool_stats', '', 'successful_calls', {cif('success = 1')} FROM t
    UNION ALL SELECT 'tool_stats', '', 'avg_duration', {avg('duration_ms')} FROM t
    UNION ALL SELECT 'activity_stats', '', 'total_events', count(*) FROM a
    UNION ALL SELECT 'activity_stats', '', 'unique_event_types', count(DISTINCT event_type) FROM a
    UNION ALL SELECT 'routing_stats', '', 'total_decisions', count(*) FROM ro
    UNION ALL SELECT 'routing_stats', '', 'avg_dq_score', {avg('dq_score')} FROM ro
    UNION ALL SELECT 'routing_stats', '', 'avg_complexity', {avg('complexity')} FROM ro
    UNION ALL SELECT 'session_stats', '', 'total_sessions', count(DISTINCT session_id) FROM so
    UNION ALL SELECT 'session_stats', '', 'avg_quality', {avg('quality_score')} FROM so
    UNION ALL SELECT 'session_stats', '', 'avg_messages', {avg('message_count')} FROM so""")
query("e101_legacy_model_outcomes", lambda b: s.legacy_model_outcomes(b.sessions.select("outcome", F.create_map(
    F.col("model"), F.col("message_count"), F.concat(F.lit("aux-"), F.col("model")), F.col("tool_count"))
    .alias("models_used"))), f"""
    SELECT m AS model, count(*) AS total, {out('success')} AS success, {pct(out('success'), 'count(*)')} AS success_rate
    FROM (SELECT model AS m, outcome FROM sessions UNION ALL SELECT 'aux-' || model, outcome FROM sessions) GROUP BY 1""")
OUT_H = f"""oh AS (SELECT *, {hour('(timestamp + id * 977)')} AS hr FROM session_outcome_events)"""


def with_hours(b):
    """Ship dates carry no time of day; the order key spreads them over the hours."""
    return b.session_outcome_events.withColumn("hr", hour_of(F.col("timestamp") + F.col("id") * 977))


query("e94_success_patterns", lambda b: s.success_by(with_hours(b), F.col("hr")), f"""
    WITH {OUT_H}
    SELECT 'hour' AS dimension, CAST(hr AS VARCHAR) AS value, {out('success')} AS success, count(*) AS total
    FROM oh GROUP BY 2
    UNION ALL SELECT 'model', coalesce(model_used, 'unknown'), {out('success')}, count(*) FROM oh GROUP BY 2
    UNION ALL SELECT 'complexity', CASE WHEN coalesce(complexity, 0.5e0) > 0.6 THEN 'high' ELSE 'low' END,
    {out('success')}, count(*) FROM oh GROUP BY 2""")
HS = f"""{OUT_H}, hs AS (SELECT hr AS hour, count(*) AS total, {out('success')} AS success,
         {dsum('coalesce(quality_score, 3e0)')} AS quality_sum FROM oh GROUP BY 1)"""
query("e95_hourly_success", lambda b: s.hourly_success(with_hours(b), F.col("hr")), f"WITH {HS} SELECT * FROM hs")
OH = f"""{HS}, opt AS (SELECT hour, {r('CAST(success AS DOUBLE) / total * 0.6e0 + quality_sum / total / 5 * 0.4e0', 6)}
         AS score, CAST(success AS DOUBLE) / total AS success_rate, quality_sum / total AS avg_quality,
         total AS sample_size FROM hs WHERE total >= 3 ORDER BY score DESC, hour LIMIT 5),
         ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, hour) AS rank FROM opt)"""
query("l10_g09_optimal_hours", lambda b: s.optimal_hours(s.hourly_success(with_hours(b), F.col("hr"))),
      f"WITH {OH} SELECT * FROM ranked")
query("f13_should_start_now", lambda b: current_rank(
    s.optimal_hours(s.hourly_success(with_hours(b), F.col("hr"))), 14), f"""
    WITH {OH}, c AS (SELECT coalesce(max(rank) FILTER (WHERE hour = 14), count(*) + 1) AS rk,
                     coalesce(max(score) FILTER (WHERE hour = 14), 0.5e0) AS sc,
                     max(hour) FILTER (WHERE rank = 1) AS bh, max(score) AS bs FROM ranked)
    SELECT CAST(14 AS BIGINT) AS current_hour, rk AS current_rank, sc AS current_score, bh AS best_hour,
           bs AS best_score, CASE WHEN sc > 0.6 THEN 'Start now' ELSE 'Consider waiting until ' || bh || ':00' END
           AS recommendation FROM c""")
query("l09_success_probability", lambda b: s.success_probability(
    b.routing_decisions.select(F.col("selected_model").alias("model"), "complexity").distinct(),
    s.success_by(with_hours(b), F.col("hr")), 14), f"""
    WITH {OUT_H}, c AS (SELECT DISTINCT selected_model AS model, complexity FROM routing_decisions),
    h AS (SELECT CAST({out('success')} AS DOUBLE) / count(*) AS x FROM oh WHERE hr = 14),
    m AS (SELECT model_used, CAST({out('success')} AS DOUBLE) / count(*) AS x FROM oh GROUP BY 1),
    k AS (SELECT CASE WHEN coalesce(complexity, 0.5e0) > 0.6 THEN 'high' ELSE 'low' END AS band,
          CAST({out('success')} AS DOUBLE) / count(*) AS x FROM oh GROUP BY 1),
    f AS (SELECT c.*, coalesce((SELECT x FROM h), 0.5e0) AS hour_factor, coalesce(m.x, 0.5e0) AS model_factor,
                 coalesce(k.x, 0.5e0) AS complexity_factor FROM c LEFT JOIN m ON model = model_used
          LEFT JOIN k ON band = CASE WHEN complexity > 0.6 THEN 'high' ELSE 'low' END),
    p AS (SELECT *, {r('hour_factor * 0.3e0 + model_factor * 0.4e0 + complexity_factor * 0.3e0', 6)}
                 AS success_probability FROM f)
    SELECT *, CASE WHEN success_probability < 0.5 THEN 'Consider waiting for a better hour or using a different model'
           WHEN success_probability < 0.7 THEN 'Proceed with caution, break into smaller tasks'
           ELSE 'Good conditions for this task' END AS advice FROM p""")
query("c13_sessions_since", lambda b: fl.sessions_since(b.sessions, 2000, as_of=LINES_NOW, project="/p/c7"), f"""
    SELECT * FROM sessions WHERE started_at >= {LINES_NOW - 2000 * 86400} AND project_path = '/p/c7'""")
query("c05_open_or_recent", lambda b: fl.open_or_recent(b.sessions, "ended_at", 5, as_of=LINES_NOW).agg(
    F.count(F.lit(1)).alias("active")), f"""
    SELECT count(*) AS active FROM sessions WHERE ended_at IS NULL OR ended_at > {LINES_NOW - 300}""")
query("c06_today_lookup", lambda b: fl.on_day(b.daily_stats, "date", "2001-10-01").select(
    (F.col("opus_messages") + F.col("sonnet_messages") + F.col("haiku_messages")).alias("messages"),
    "session_count", "tool_calls"), """
    SELECT opus_messages + sonnet_messages + haiku_messages AS messages, session_count, tool_calls
    FROM daily_stats WHERE date = '2001-10-01'""")

# ---- routing ---------------------------------------------------------------
query("e40_routing_stats", lambda b: rt.stats(b.since(L60).routing_decisions, as_of=LINES_NOW, days=60), f"""
    SELECT count(*) AS total, {avg('dq_score')} AS avg_dq,
           {', '.join(f"{cif(f'selected_model = {chr(39)}{m}{chr(39)}')} AS {m}_count" for m in T)}
    FROM routing_decisions WHERE timestamp >= {L60}""")
query("e41_t02_nonzero_dq", lambda b: rt.nonzero_dq(b.routing_decisions), f"""
    SELECT count(*) AS total, {avg('dq_score')} AS avg_dq FROM routing_decisions
    WHERE dq_score IS NOT NULL AND dq_score <> 0""")
TREND = f"""
    SELECT {day('timestamp')} AS date, count(*) AS queries, {r(avg('dq_score'), 3)} AS avg_dq,
           {r(avg('complexity'), 3)} AS avg_complexity,
           {', '.join(f"{cif(f'selected_model = {chr(39)}{m}{chr(39)}')} AS {m}" for m in T)}
    FROM routing_decisions GROUP BY 1"""
query("e42_routing_daily", lambda b: rt.daily_trend(b.routing_decisions), TREND)
query("g05_routing_recent_days", lambda b: rt.recent_trend(b.routing_decisions), f"""
    SELECT date, queries, avg_dq, avg_complexity FROM ({TREND}) ORDER BY date DESC LIMIT 30""")
query("e43_dq_components", lambda b: rt.dq_components(b.routing_decisions), f"""
    SELECT {', '.join(f"{r(avg(f'dq_{c}'), 3)} AS {c}" for c in ('validity', 'specificity', 'correctness'))}
    FROM routing_decisions WHERE dq_validity IS NOT NULL""")
query("e44_complexity_by_model", lambda b: rt.complexity_by_model(b.routing_decisions), f"""
    SELECT selected_model, {r('min(complexity)', 3)} AS min, {r(avg('complexity'), 3)} AS avg,
           {r('max(complexity)', 3)} AS max, count(*) AS n FROM routing_decisions WHERE complexity IS NOT NULL
    GROUP BY 1""")
query("e45_expertise_domains", lambda b: rt.expertise_domains(b.expertise_routing_events), f"""
    WITH p AS (SELECT domain, chosen_model, count(*) AS n, row_number() OVER (PARTITION BY domain
               ORDER BY count(*) DESC, chosen_model) AS rn FROM expertise_routing_events GROUP BY 1, 2)
    SELECT e.domain, count(*) AS n, {r(avg('expertise_level'), 3)} AS avg_expertise,
           {r(avg('query_complexity'), 3)} AS avg_complexity, min(p.chosen_model) AS primary_model
    FROM expertise_routing_events e JOIN p ON p.domain = e.domain AND rn = 1 GROUP BY 1""")
query("t08_primary_model", lambda b: rt.primary_model(b.expertise_routing_events), """
    SELECT domain, chosen_model FROM (SELECT domain, chosen_model, row_number() OVER (PARTITION BY domain
    ORDER BY count(*) DESC, chosen_model) AS rn FROM expertise_routing_events GROUP BY 1, 2) WHERE rn = 1""")
query("e46_model_success", lambda b: rt.model_success(b.session_outcome_events), f"""
    SELECT model_used, count(*) AS total, {pct(out('success'), 'count(*)')} AS success_rate
    FROM session_outcome_events WHERE model_used IS NOT NULL GROUP BY 1""")
query("e46_pooled_accuracy", lambda b: rt.pooled_accuracy(b.session_outcome_events, b.routing_decisions), f"""
    SELECT count(*) AS feedback_count, {pct(out('success'), 'count(*)')} AS accuracy FROM session_outcome_events
    WHERE model_used IS NOT NULL""")
SHARE = f"""sh AS (SELECT selected_model AS model, count(*) AS n,
            {r('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM routing_decisions)', 3)} AS share
            FROM routing_decisions GROUP BY 1)"""
SAVING = (f"sv AS (SELECT CASE WHEN o < 1 THEN {r('(1e0 - (h * 0.16e0 + s * 0.6e0 + o)) * 100', 1)} ELSE 0e0 END "
          "AS cost_reduction FROM (SELECT sum(share) FILTER (WHERE model = 'haiku') AS h, sum(share) FILTER "
          "(WHERE model = 'sonnet') AS s, sum(share) FILTER (WHERE model = 'opus') AS o FROM sh))")
query("e47_model_share", lambda b: rt.model_share(b.routing_decisions), f"WITH {SHARE} SELECT * FROM sh")
query("l19_routing_saving", lambda b: rt.routing_saving(rt.model_share(b.routing_decisions)),
      f"WITH {SHARE}, {SAVING} SELECT * FROM sv")
query("l20_targets_met", lambda b: rt.targets_met(
    rt.pooled_accuracy(b.session_outcome_events, b.routing_decisions),
    rt.routing_saving(rt.model_share(b.routing_decisions)), rt.nonzero_dq(b.routing_decisions), latency_ms=None), f"""
    WITH {SHARE}, {SAVING}
    SELECT CAST((SELECT {pct(out('success'), 'count(*)')} >= 60 FROM session_outcome_events) AS BIGINT)
         + CAST((SELECT cost_reduction >= 20 FROM sv) AS BIGINT)
         + CAST((SELECT {avg('dq_score')} >= 0.8 FROM routing_decisions WHERE dq_score <> 0) AS BIGINT) AS targets_met,
           CAST(4 AS BIGINT) AS targets""")
query("e48_routing_accuracy_view", lambda b: rt.accuracy_view(b.routing_decisions), f"""
    SELECT selected_model, count(*) AS total_decisions, {cif('success = 1')} AS successes,
           {cif('success = 0')} AS failures, {r(avg('dq_score'), 3)} AS avg_dq_score,
           {pct(cif('success = 1'), 'count(success)')} AS accuracy_pct FROM routing_decisions GROUP BY 1""")
query("e54_quality_by_model", lambda b: rt.mean_quality_by_model(b.session_outcome_events, 500), f"""
    SELECT coalesce(model_used, 'unknown') AS model, {avg('quality_score')} AS quality FROM
    (SELECT * FROM session_outcome_events ORDER BY timestamp DESC, id DESC, quality_score DESC LIMIT 500) GROUP BY 1""")
query("e54_quality_by_model_all", lambda b: rt.mean_quality_by_model(b.session_outcome_events), f"""
    SELECT coalesce(model_used, 'unknown') AS model, {avg('quality_score')} AS quality FROM session_outcome_events
    GROUP BY 1""")
EXP = f"FROM expertise_routing_events WHERE timestamp > {L365}"
LEV = f"{r(avg('expertise_level'), 2)} AS avg_expertise, {r(avg('query_complexity'), 2)} AS avg_complexity"
query("e49_expertise_heatmap", lambda b: rt.expertise_heatmap(b.since(L365).expertise_routing_events, as_of=LINES_NOW, days=365),
      f"SELECT domain, chosen_model AS model, count(*) AS n, {LEV} {EXP} GROUP BY 1, 2")
query("e50_i16_expertise_summary", lambda b: rt.expertise_summary(
    b.since(L365).expertise_routing_events, as_of=LINES_NOW, days=365), f"""
    SELECT domain, count(*) AS total_queries, {LEV},
           string_agg(DISTINCT chosen_model, ',' ORDER BY chosen_model) AS models_used {EXP} GROUP BY 1""")
query("e51_complexity_levels", lambda b: rt.complexity_levels(b.since(L365).expertise_routing_events, as_of=LINES_NOW, days=365),
      f"""SELECT CASE WHEN query_complexity < 0.3 THEN 'low' WHEN query_complexity < 0.6 THEN 'medium'
          WHEN query_complexity < 0.8 THEN 'high' ELSE 'extreme' END AS level, chosen_model AS model, count(*) AS n
          {EXP} GROUP BY 1, 2""")
query("e52_expertise_totals", lambda b: rt.expertise_totals(b.since(L365).expertise_routing_events, as_of=LINES_NOW, days=365),
      f"SELECT count(*) AS total_events, count(DISTINCT domain) AS unique_domains, {LEV} {EXP}")
query("e53_log_avg_dq", lambda b: rt.log_avg_dq(b.dq_log, as_of=EVENTS_NOW, days=30), f"""
    SELECT coalesce({avg('v')}, 0.75e0) AS avg_dq FROM
    (SELECT CASE WHEN ts > 4102444800 THEN ts / 1000 ELSE ts END AS t, coalesce(dqScore, dq, dq_obj_score, 0) AS v
     FROM dq_log) WHERE t > {EVENTS_NOW - 30 * 86400} AND v > 0""")
query("e55_prediction_accuracy", lambda b: rt.prediction_accuracy(b.predictions), f"""
    SELECT count(*) AS total, {cif('correct = 1')} AS correct, {pct(cif('correct = 1'), 'count(*)')} AS accuracy
    FROM predictions""")
query("e55_prediction_distribution", lambda b: rt.prediction_distribution(b.predictions), """
    SELECT CASE WHEN predicted IN ('success', 'abandon', 'partial') THEN predicted ELSE 'unknown' END AS predicted,
           count(*) AS n FROM predictions GROUP BY 1""")
query("e55_prediction_daily", lambda b: rt.prediction_daily(b.predictions), f"""
    SELECT {day('timestamp')} AS date, count(*) AS total, {cif('correct = 1')} AS correct,
           {pct(cif('correct = 1'), 'count(*)')} AS accuracy FROM predictions GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
query("e102_collapse_other", lambda b: rt.collapse_other(b.sessions, "model", T), """
    SELECT CASE WHEN model IN ('opus', 'sonnet', 'haiku') THEN model ELSE 'Other' END AS value, count(*) AS n
    FROM sessions WHERE model IS NOT NULL GROUP BY 1""")
query("g01_recent_routing", lambda b: latest(
    fl.within_days(b.since(L60).routing_events, "timestamp", 60, as_of=LINES_NOW), "timestamp", 100), f"""
    SELECT * FROM routing_events WHERE timestamp > {L60} ORDER BY timestamp DESC, id DESC, dq_score DESC LIMIT 100""")
