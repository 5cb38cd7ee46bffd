"""Rules and scores."""

from pyspark.sql import functions as F

from tracewell.functions import scoring as sc
from tracewell.functions.exprs import day_of, hour_of, rnd, weekday_name
from tracewell.operators import health as h
from tracewell.operators import sessions as s
from tracewell.operators.windows import current_rank
from tracewell.plans.catalogue.sessions_routing import OH, OUT_H, out, with_hours
from tracewell.plans.registry import EVENTS_NOW as NOW
from tracewell.plans.registry import avg, day, dbl, dec, dsum, hour, query, r

# The invented prose holds none of the signal words, so the probe column adds one by source.
_PROBE = """CASE source WHEN 'src1' THEN 'Design it. ' WHEN 'src2' THEN 'quick FIX ' WHEN 'src3' THEN 'explain '
            WHEN 'src4' THEN 'refactor ' ELSE '' END || text"""


def signals(col):
    hits = ", ".join(f"CASE WHEN contains(lower({col}), '{k}') THEN {w}e0 ELSE 0.5e0 END"
                     for k, w in sc.COMPLEXITY_SIGNALS.items())
    return f"greatest(0.5e0, {hits})"


query("l08_complexity_tier", lambda b: b.documents.select(
    "doc_id", sc.query_complexity(F.expr(_PROBE)).alias("complexity")).withColumns({
        "model": sc.recommended_tier("complexity"),
        "confidence": rnd(sc.routing_confidence("complexity", F.lit(12)), 2),
        "confidence_off_peak": sc.routing_confidence("complexity", F.lit(9))}), f"""
    WITH c AS (SELECT doc_id, {signals(f'({_PROBE})')} AS complexity FROM documents),
    m AS (SELECT *, CASE WHEN complexity >= 0.7 THEN 'opus' WHEN complexity >= 0.4 THEN 'sonnet' ELSE 'haiku' END AS model,
          CASE WHEN complexity >= 0.7 THEN 0.85e0 WHEN complexity >= 0.4 THEN 0.8e0 ELSE 0.75e0 END AS cf FROM c)
    SELECT doc_id, complexity, model, {r('least(cf + 0.1e0, 0.95e0)', 2)} AS confidence, cf AS confidence_off_peak FROM m""")
SPEND = f"""cd AS (SELECT {day('ts')} AS d, {dsum('cost_usd')} AS c FROM cost_tracking GROUP BY 1),
    sp AS (SELECT {avg('c')} AS baseline, coalesce({dbl(f"sum({dec('c')}) FILTER (WHERE d = '2024-01-30')")}, 0e0) AS today
           FROM cd),
    pp AS (SELECT *, {r('today + today / 18e0 * 6e0', 2)} AS predicted FROM sp),
    fd AS (SELECT today, predicted, baseline, CASE WHEN predicted > baseline * 1.5e0 THEN 'warning' ELSE 'ok' END
           AS status, CASE WHEN predicted > 300 THEN 'Switch to Sonnet/Haiku for remaining tasks' WHEN predicted >
           baseline * 1.3e0 THEN 'Consider batching remaining requests' ELSE 'On track' END AS action FROM pp)"""


def forecast(b):
    return h.forecast_day(h.spend_baseline(b.cost_tracking, as_of=NOW - 3600), hours_elapsed=18.0)


query("l11_forecast_day", forecast, f"WITH {SPEND} SELECT * FROM fd")


def advised(b):
    """Advice per routed (model, complexity) pair."""
    cases = b.routing_decisions.select(F.col("selected_model").alias("model"), "complexity").distinct()
    patterns = s.success_by(with_hours(b), F.col("hr"))
    cases = s.success_probability(cases, patterns, 14).withColumn(
        "confidence", sc.routing_confidence("complexity", F.lit(14)))
    return h.advice(cases, forecast(b), 0.45).select("model", "complexity", "success_probability", "recommendation")


query("l12_advice", advised, f"""
    WITH {OUT_H}, {SPEND}, c AS (SELECT DISTINCT selected_model AS model, complexity FROM routing_decisions),
    h AS (SELECT CAST({out('success')} AS DOUBLE) / count(*) AS x FROM oh WHERE hr = 14),
    m AS (SELECT model_used, CAST({out('success')} AS DOUBLE) / count(*) AS x FROM oh GROUP BY 1),
    k AS (SELECT CASE WHEN complexity > 0.6 THEN 'high' ELSE 'low' END AS band,
          CAST({out('success')} AS DOUBLE) / count(*) AS x FROM oh GROUP BY 1),
    p AS (SELECT c.*, {r('(SELECT x FROM h) * 0.3e0 + m.x * 0.4e0 + k.x * 0.3e0', 6)} AS sp FROM c
          JOIN m ON model = model_used JOIN k ON band = CASE WHEN complexity > 0.6 THEN 'high' ELSE 'low' END)
    SELECT model, complexity, sp AS success_probability, 'Caution: ' ||
           CASE WHEN sp < 0.5 THEN 'low success probability, ' ELSE '' END ||
           CASE WHEN (SELECT status FROM fd) = 'warning' THEN 'cost trending high, ' ELSE '' END ||
           'suboptimal hour. Consider: ' || CASE WHEN sp < 0.5 THEN
           'Consider waiting for a better hour or using a different model' WHEN sp < 0.7 THEN
           'Proceed with caution, break into smaller tasks' ELSE 'Good conditions for this task' END AS recommendation
    FROM p""")
query("l12_start_advice", lambda b: current_rank(s.optimal_hours(s.hourly_success(with_hours(b), F.col("hr"))), 99), f"""
    WITH {OH}, c AS (SELECT count(*) + 1 AS rk, max(hour) FILTER (WHERE rank = 1) AS bh, max(score) AS bs FROM ranked)
    SELECT CAST(99 AS BIGINT) AS current_hour, rk AS current_rank, 0.5e0 AS current_score, bh AS best_hour,
           bs AS best_score, 'Consider waiting until ' || bh || ':00' AS recommendation FROM c""")
MODE = """CASE WHEN h >= 5 AND h < 9 THEN 'morning' WHEN h >= 9 AND h < 12 OR h >= 14 AND h < 18 THEN 'peak'
          WHEN h >= 12 AND h < 14 THEN 'dip' WHEN h >= 18 AND h < 22 THEN 'evening' ELSE 'deep_night' END"""


def modes(b):
    e = b.flow_history.select("id", hour_of("timestamp").alias("_h"), weekday_name(day_of("timestamp")).alias("weekday"),
                              F.col("score").alias("energy"))
    return e.withColumn("mode", sc.day_mode("_h")).withColumns({
        "model": sc.mode_model(F.col("mode")), "tasks": F.array_join(sc.mode_tasks(F.col("mode")), ","),
        "energy_label": sc.energy_label("energy"),
        "warnings": F.array_join(sc.day_warnings("energy", F.col("mode")), "; "),
        "in_flow": sc.in_flow("energy").cast("bigint"), "level": sc.level("energy")}).drop("_h")


_TASKS = " ".join(f"WHEN '{m}' THEN '{','.join(t)}'" for m, t in sc.MODE_TASKS.items())
_MODELS = " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in sc.MODE_MODEL.items())
query("l22_l24_l25_day_mode", modes, f"""
    WITH f AS (SELECT id, {hour('timestamp')} AS h, dayname(make_timestamp(timestamp * 1000000)) AS weekday,
               score AS energy FROM flow_history), m AS (SELECT *, {MODE} AS mode FROM f)
    SELECT id, weekday, energy, mode, CASE mode {_MODELS} END AS model, CASE mode {_TASKS} END AS tasks,
           CASE WHEN energy >= 0.7 THEN 'HIGH' WHEN energy >= 0.5 THEN 'MED' ELSE 'LOW' END AS energy_label,
           CASE WHEN energy < 0.5 AND mode = 'dip' THEN 'Low energy day - consider lighter tasks; Post-lunch dip - avoid complex architecture'
                WHEN energy < 0.5 THEN 'Low energy day - consider lighter tasks'
                WHEN mode = 'dip' THEN 'Post-lunch dip - avoid complex architecture' ELSE '' END AS warnings,
           CAST(energy >= 0.75 AS BIGINT) AS in_flow, CASE WHEN energy >= 0.7 THEN 'surge' WHEN energy >= 0.4
           THEN 'active' WHEN energy >= 0.2 THEN 'steady' ELSE 'calm' END AS level FROM m""")
query("l23_window_advice", lambda b: b.events_k.select("event_id", F.array_join(sc.window_advice(
    F.when(F.col("k") < 30, F.lit("CRITICAL")).when(F.col("k") < 60, F.lit("LOW")).otherwise(F.lit("OK")), F.col("k"),
    F.col("value"), F.size(F.split("event_type", "i"))), "; ").alias("advice")), """
    WITH a AS (SELECT event_id, CASE WHEN k < 30 THEN '; Switch to Haiku for remaining tasks' WHEN k < 60
               THEN '; Avoid Opus unless critical' ELSE '' END || CASE WHEN k > 80
               THEN '; Late in window - prioritize completion' ELSE '' END || CASE WHEN value > 85
               THEN '; Budget pressure - consider model downgrade' ELSE '' END AS t FROM events_k)
    SELECT event_id, CASE WHEN t = '' THEN 'Session healthy - proceed normally' ELSE substr(t, 3) END AS advice FROM a""")
