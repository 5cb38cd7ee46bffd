"""Scalar expressions over the bound tables."""

from pyspark.sql import functions as F

from tracewell.functions import exprs as e
from tracewell.plans.registry import EVENTS_NOW as NOW
from tracewell.plans.registry import cif, day, fixed, hour, query, r

query("i01_i06_calendar", lambda b: b.tool_events.select(
    "id", e.day_of("timestamp").alias("day"), e.month_of(e.day_of("timestamp")).alias("month"),
    e.hour_of("timestamp").alias("hour"), e.hour_start("timestamp").alias("hour_start"),
    e.datetime_of("timestamp").alias("datetime"), e.month_day(e.day_of("timestamp")).alias("label"),
    e.weekday_name(e.day_of("timestamp")).alias("weekday"), e.clock_of("timestamp").alias("clock")), f"""
    SELECT id, {day('timestamp')} AS day, substr({day('timestamp')}, 1, 7) AS month, {hour('timestamp')} AS hour,
           strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:00:00') AS hour_start,
           strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') AS datetime,
           strftime(make_timestamp(timestamp * 1000000), '%m/%d') AS label,
           dayname(make_timestamp(timestamp * 1000000)) AS weekday,
           strftime(make_timestamp(timestamp * 1000000), '%H:%M:%S') AS clock FROM tool_events""")
query("i05_session_minutes", lambda b: b.sessions.select("id", e.minutes_between("started_at", "ended_at").alias("minutes")),
      f"SELECT id, {r('(ended_at - started_at) / 60e0', 1)} AS minutes FROM sessions")
query("i07_duration_text", lambda b: b.sessions.select("id", e.duration_text(
    F.greatest(F.coalesce(F.col("ended_at") - F.col("started_at"), F.lit(0)), F.lit(0)) + F.col("message_count") * 61).alias("duration")), """
    WITH x AS (SELECT id, greatest(coalesce(ended_at - started_at, 0), 0) + message_count * 61 AS s FROM sessions)
    SELECT id, CASE WHEN s // 86400 = 1 THEN '1 day, ' WHEN s // 86400 > 1 THEN (s // 86400) || ' days, ' ELSE '' END
           || (s // 3600 % 24) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' ||
           lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration FROM x""")
query("i09_iso_hour", lambda b: b.events.select("event_id", e.iso_hour(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
                                                .alias("hour"), e.iso_hour("event_type").alias("bad")), """
    SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour, CAST(NULL AS BIGINT) AS bad FROM events""")
query("i10_i14_numbers", lambda b: b.tool_events.select(
    "id", e.rnd("duration_ms", 1).alias("rounded"), F.col("duration_ms").cast("bigint").alias("whole"),
    e.clamp(F.col("duration_ms"), 1.0, 50.0).alias("clamped"),
    e.truthy_or("success", F.lit(-1)).cast("bigint").alias("truthy"),
    e.ratio(F.col("duration_ms"), F.col("success")).alias("guarded"),
    e.nonblank("error_message", default="none").alias("message")), f"""
    SELECT id, {r('duration_ms', 1)} AS rounded, CAST(trunc(duration_ms) AS BIGINT) AS whole,
           least(50e0, greatest(1e0, duration_ms)) AS clamped, CAST(CASE WHEN success = 0 THEN -1 ELSE success END AS BIGINT) AS truthy,
           duration_ms / nullif(success, 0) AS guarded, coalesce(nullif(error_message, ''), 'none') AS message
    FROM tool_events""")
query("i15_i17_model_names", lambda b: b.turns.select(
    "session_id", "turn", e.tier_of("model").alias("tier"), e.tier_of("model", default=None).alias("strict_tier")), """
    SELECT session_id, turn, CASE WHEN model LIKE '%opus%' THEN 'opus' WHEN model LIKE '%sonnet%' THEN 'sonnet'
           WHEN model LIKE '%haiku%' THEN 'haiku' ELSE 'opus' END AS tier, CASE WHEN model LIKE '%opus%' THEN 'opus'
           WHEN model LIKE '%sonnet%' THEN 'sonnet' WHEN model LIKE '%haiku%' THEN 'haiku' END AS strict_tier
    FROM turns""")
query("i18_text_parts", lambda b: b.sync_events.select(
    "id", e.basename("session_pwd").alias("base"), e.first_token("metadata").alias("first"),
    e.preview("metadata", 12).alias("start")), r"""
    SELECT id, regexp_extract(session_pwd, '([^/]*)$', 1) AS base,
           coalesce(nullif(regexp_extract(trim(metadata), '^(\S*)', 1), ''), 'unknown') AS first,
           substr(metadata, 1, 12) AS start FROM sync_events""")


def mixed(b):
    """Timestamps in all forms found in logs, chosen by the event type."""
    iso = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    t = F.col("timestamp").cast("string")
    return b.events_k.select("event_id", "timestamp", F.when(F.col("event_type") == "click", iso)
                             .when(F.col("event_type") == "view", F.concat(iso, F.lit("Z")))
                             .when(F.col("event_type") == "purchase", t)
                             .when(F.col("event_type") == "signup", F.concat(t, F.lit("000")))
                             .otherwise(F.lit("not-a-date")).alias("raw"))


query("i20_event_ts", lambda b: mixed(b).select(
    "event_id", F.unix_timestamp(e.event_ts("raw")).alias("parsed"), (F.col("timestamp")).alias("expected")), """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN timestamp END AS parsed, timestamp AS expected
    FROM events_k""")
query("i21_row_hash", lambda b: b.nation.select("n_nationkey", e.canonical_hash(["n_name", "n_nationkey"]).alias("h")), """
    SELECT n_nationkey, md5('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS h FROM nation""")
_AGE = f"(({NOW} - timestamp) / 3600e0)"
query("i22_age_label", lambda b: b.tool_events.select("id", e.age_label(
    (F.lit(NOW) - F.col("timestamp")) / F.lit(3600.0)).alias("age")), f"""
    SELECT id, CASE WHEN {_AGE} < 1 THEN CAST(CAST(floor({_AGE} * 60) AS BIGINT) AS VARCHAR) || 'm ago'
           WHEN {_AGE} < 24 THEN {fixed(_AGE, 1)} || 'h ago' ELSE {fixed(f'{_AGE} / 24', 1)} || 'd ago' END AS age
    FROM tool_events""")
query("i23_json_roundtrip", lambda b: b.events_k.select(
    "event_id", F.to_json(F.from_json("props", "k bigint")).alias("again"),
    F.element_at(F.from_json("props", "map<string,bigint>"), "k").alias("k")), """
    SELECT event_id, '{"k":' || k || '}' AS again, k FROM events_k""")
_BIG = "(o_totalprice * (1 + o_custkey * o_custkey))"
query("i24_humanize", lambda b: b.orders.select(
    "o_orderkey", e.humanize(F.col("o_totalprice") * (1 + F.col("o_custkey") * F.col("o_custkey"))).alias("n"),
    e.money_text(F.col("o_totalprice") / 100000).alias("usd")), f"""
    SELECT o_orderkey, CASE WHEN {_BIG} >= 1e9 THEN {fixed(f'{_BIG} / 1e9', 1)} || 'B' WHEN {_BIG} >= 1e6
           THEN {fixed(f'{_BIG} / 1e6', 1)} || 'M' ELSE {fixed(f'{_BIG} / 1e3', 1)} || 'K' END AS n,
           CASE WHEN o_totalprice / 100000 >= 1 THEN '$' || {fixed('o_totalprice / 100000', 2)}
           ELSE '$' || {fixed('o_totalprice / 100000', 4)} END AS usd FROM orders""")
query("i25_elapsed_minutes", lambda b: b.events_k.select("event_id", e.elapsed_minutes(
    F.when(F.col("event_type") == "click", F.format_string("%d-%02d:%02d:09", "k", F.col("k") % 24, F.col("k") % 60))
    .when(F.col("event_type") == "view", F.format_string("%02d:%02d:00", F.col("k") % 24, F.col("k") % 60))
    .when(F.col("event_type") == "signup", F.lit("?")).otherwise(F.format_string("%02d:30", F.col("k") % 60)))
    .alias("minutes")), """
    SELECT event_id, CASE event_type WHEN 'click' THEN k * 1440 + k % 24 * 60 + k % 60 WHEN 'view'
           THEN k % 24 * 60 + k % 60 WHEN 'signup' THEN 0 ELSE k % 60 END AS minutes FROM events_k""")
query("i26_keyword_weight", lambda b: b.documents.select("doc_id", e.keyword_weight(
    "text", {"over": 0.9, "est": 0.7, "ing": 0.3}, 0.5).alias("weight")), """
    SELECT doc_id, CASE WHEN contains(lower(text), 'over') THEN 0.9e0 WHEN contains(lower(text), 'est') THEN 0.7e0
           ELSE 0.5e0 END AS weight FROM documents""")
query("i27_map_defaults", lambda b: b.project_files.groupBy("project").agg(F.map_from_entries(F.collect_list(
    F.struct("ext", F.col("files").cast("double")))).alias("m")).select("project", e.with_defaults(
        "m", {"en": 0.0, "xx": 7.0}).alias("m")).select("project", F.element_at("m", "en").alias("en"),
                                                         F.element_at("m", "xx").alias("xx")), """
    SELECT project, CAST(coalesce(sum(files) FILTER (WHERE ext = 'en'), 0) AS DOUBLE) AS en, 7e0 AS xx
    FROM project_files GROUP BY 1""")
query("t03_true_division", lambda b: b.tool_events.agg(
    (F.count_if(F.col("success") == 1).cast("double") / F.count(F.lit(1))).alias("fraction")),
      f"SELECT CAST({cif('success = 1')} AS DOUBLE) / count(*) AS fraction FROM tool_events")
