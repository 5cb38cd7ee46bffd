"""Windows, streaks and ordered analytics."""

from pyspark.sql import functions as F

from tracewell.functions.exprs import day_of, exact_sum, rnd
from tracewell.operators import sketches
from tracewell.operators import streaks as st
from tracewell.operators import tools as t
from tracewell.operators import windows as w
from tracewell.plans.registry import EVENTS_NOW as NOW
from tracewell.plans.registry import avg, cif, day, dsum, hour, isum, query, r
from tracewell.session import checkpointed

# Gaps in the event log are minutes, so queries join events up to 10 minutes apart.
GAP, MIN = 600, 600
_ISL = """
    o AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (ORDER BY timestamp, id) <= {gap} THEN 0 ELSE 1 END AS nw
          FROM tool_events),
    i AS (SELECT *, sum(nw) OVER (ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS g FROM o),
    sa AS (SELECT g, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n FROM i GROUP BY g),
    sk AS (SELECT g, start_ts, end_ts, end_ts - start_ts AS duration_seconds, n AS tool_count,
           {rr} AS avg_gap_seconds FROM sa WHERE end_ts - start_ts >= {mn})"""
RR = r("(end_ts - start_ts) / CAST(greatest(n - 1, 1) AS DOUBLE)", 2)
ISL = _ISL.format(gap=GAP, mn=MIN, rr=RR)
COLS = "start_ts, end_ts, duration_seconds, tool_count, avg_gap_seconds"


def streaks(b):
    return st.sessionize(b.tool_events, "timestamp", gap_s=GAP, min_s=MIN)


query("f01_streaks", streaks, f"WITH {ISL} SELECT {COLS} FROM sk")
query("f01_streaks_default_gap", lambda b: st.sessionize(b.tool_events, "timestamp", gap_s=30, min_s=0),
      f"WITH {_ISL.format(gap=30, mn=0, rr=RR)} SELECT {COLS} FROM sk")
_KEYED = _ISL.format(gap=7200, mn=3600, rr=RR).replace("OVER (ORDER", "OVER (PARTITION BY session_id ORDER").replace(
    "SELECT g, min", "SELECT session_id, g, min").replace("GROUP BY g", "GROUP BY session_id, g").replace(
    "SELECT g, start_ts", "SELECT session_id, g, start_ts")
query("f01_streaks_per_session", lambda b: st.sessionize(
    b.tool_events, "timestamp", gap_s=7200, min_s=3600, keys=["session_id"]),
      f"WITH {_KEYED} SELECT session_id, {COLS} FROM sk")


def freq(v):
    return f"""fq AS (SELECT start_ts, {v}, count(*) AS n, row_number() OVER (PARTITION BY start_ts
               ORDER BY count(*) DESC, {v}) AS rank FROM i JOIN sk USING (g) WHERE {v} IS NOT NULL GROUP BY 1, 2)"""


query("e97_streak_tools", lambda b: st.streak_frequencies(
    b.tool_events, "timestamp", "tool_name", gap_s=GAP, min_s=MIN),
      f"WITH {ISL}, {freq('tool_name')} SELECT * FROM fq WHERE rank <= 10")
query("e97_streak_contexts", lambda b: st.streak_frequencies(
    b.tool_events, "timestamp", "context", gap_s=GAP, min_s=MIN),
      f"WITH {ISL}, {freq('context')} SELECT * FROM fq WHERE rank <= 10")


def table(b):
    """The derived streak table with its collections as text."""
    ends = b.sessions.withColumns({"started_at": F.col("started_at") + 757382400,
                                   "ended_at": F.col("ended_at") + 757382400})
    s = st.autonomy_streaks(b.tool_events, ends, gap_s=GAP, min_s=MIN, materialize=checkpointed)
    tools = F.transform(F.map_entries("top_tools"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return s.withColumns({"projects": F.array_join("projects", ","), "top_tools": F.array_join(tools, ","),
                          "session_ids": F.array_join("session_ids", ",")})


SHIFT = 757382400   # moves the order dates onto the months of the event log
HITS = f"""lg AS (SELECT start_ts FROM sk ORDER BY duration_seconds DESC, start_ts LIMIT 50),
    hs AS (SELECT start_ts, id AS session_id, row_number() OVER (PARTITION BY start_ts ORDER BY id) AS match_rank
           FROM lg JOIN sessions ON started_at + {SHIFT} <= start_ts AND (ended_at IS NULL OR ended_at + {SHIFT}
           >= start_ts))"""
query("b09_autonomy_streaks_table", table, f"""
    WITH {ISL}, {freq('tool_name')}, fc AS (SELECT start_ts, string_agg(context, ',' ORDER BY rank) AS projects FROM
        (SELECT start_ts, context, row_number() OVER (PARTITION BY start_ts ORDER BY count(*) DESC, context) AS rank
         FROM i JOIN sk USING (g) GROUP BY 1, 2) WHERE rank <= 10 GROUP BY 1),
    ft AS (SELECT start_ts, string_agg(tool_name || ':' || n, ',' ORDER BY rank) AS top_tools FROM fq WHERE rank <= 10
           GROUP BY 1), {HITS},
    ids AS (SELECT start_ts, string_agg(session_id, ',' ORDER BY match_rank) AS session_ids FROM hs
            WHERE match_rank <= 5 GROUP BY 1)
    SELECT {COLS}, projects, top_tools, coalesce(session_ids, '') AS session_ids FROM sk LEFT JOIN fc USING (start_ts)
    LEFT JOIN ft USING (start_ts) LEFT JOIN ids USING (start_ts)""")
query("d05_open_sessions_at_streaks", lambda b: st.open_sessions(streaks(b), b.sessions.withColumns(
    {"started_at": F.col("started_at") + SHIFT, "ended_at": F.col("ended_at") + SHIFT})),
      f"WITH {ISL}, {HITS} SELECT start_ts, session_id, match_rank FROM hs WHERE match_rank <= 5")
query("e96_streak_stats", lambda b: st.streak_stats(streaks(b)), f"""
    WITH {ISL} SELECT count(*) AS total_streaks, {isum('duration_seconds')} AS total_seconds,
    {isum('tool_count')} AS total_tool_calls, {r(avg('duration_seconds'))} AS avg_duration,
    {r(avg('avg_gap_seconds'), 2)} AS avg_gap FROM sk""")
query("e96_streak_daily", lambda b: st.streak_daily(streaks(b), as_of=NOW), f"""
    WITH {ISL} SELECT {day('start_ts')} AS date, max(duration_seconds) AS longest, count(*) AS streaks,
    {isum('tool_count')} AS tools FROM sk WHERE start_ts > {NOW - 30 * 86400} GROUP BY 1""")
query("e96_streak_histogram", lambda b: st.streak_histogram(streaks(b)), f"""
    WITH {ISL}, bk AS (SELECT CASE WHEN duration_seconds < 120 THEN '<2m' WHEN duration_seconds < 300 THEN '2-5m'
    WHEN duration_seconds < 600 THEN '5-10m' WHEN duration_seconds < 1200 THEN '10-20m' WHEN duration_seconds < 2400
    THEN '20-40m' ELSE '40m+' END AS bucket FROM sk)
    SELECT x AS bucket, (SELECT count(*) FROM bk WHERE bucket = x) AS n
    FROM (VALUES ('<2m'), ('2-5m'), ('5-10m'), ('10-20m'), ('20-40m'), ('40m+')) v(x)""")
query("e98_autonomy_rate", lambda b: st.autonomy_rate(b.tool_events, streaks(b)), f"""
    WITH {ISL}, x AS (SELECT (SELECT max(timestamp) - min(timestamp) FROM tool_events) AS span_seconds,
                      (SELECT {isum('duration_seconds')} FROM sk) AS busy_seconds)
    SELECT *, {r('CAST(busy_seconds AS DOUBLE) / span_seconds * 100', 1)} AS autonomy_rate FROM x""")
query("f12_i07_top_streaks", lambda b: st.top_streaks(streaks(b)), f"""
    WITH {ISL} SELECT row_number() OVER (ORDER BY duration_seconds DESC, start_ts) AS rank,
    duration_seconds AS duration, CASE WHEN duration_seconds // 86400 = 1 THEN '1 day, ' WHEN duration_seconds // 86400 > 1
    THEN (duration_seconds // 86400) || ' days, ' ELSE '' END || (duration_seconds // 3600 % 24) || ':' || lpad(CAST(duration_seconds // 60 % 60 AS
    VARCHAR), 2, '0') || ':' || lpad(CAST(duration_seconds % 60 AS VARCHAR), 2, '0') AS duration_text,
    {day('start_ts')} AS date, strftime(make_timestamp(start_ts * 1000000), '%H:%M') AS time, tool_count,
    avg_gap_seconds AS avg_gap FROM sk ORDER BY duration_seconds DESC, start_ts LIMIT 10""")

PAIRS = """pr AS (SELECT session_id, lag(tool_name) OVER (PARTITION BY session_id ORDER BY timestamp, id) AS previous,
           tool_name AS next FROM tool_events),
    ct AS (SELECT previous, next, count(*) AS n FROM pr WHERE previous IS NOT NULL GROUP BY 1, 2),
    tr AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY previous) AS probability,
           row_number() OVER (PARTITION BY previous ORDER BY n DESC, next) AS rank FROM ct)"""
query("f02_f03_transitions", lambda b: w.transitions(b.tool_events, "tool_name", "timestamp", "id",
                                                     keys=["session_id"], top=5),
      f"WITH {PAIRS} SELECT * FROM tr WHERE rank <= 5")
query("t21_transitions_global", lambda b: w.transitions(b.tool_events, "tool_name", "timestamp", "id"),
      f"WITH {PAIRS.replace('PARTITION BY session_id ORDER BY timestamp', 'ORDER BY timestamp')} "
      "SELECT * FROM tr WHERE rank <= 5")
query("f04_predict_next", lambda b: w.predict_next(
    w.transitions(b.tool_events, "tool_name", "timestamp", "id", keys=["session_id"]),
    b.tool_events.groupBy("session_id").agg(F.max_by("tool_name", F.struct("timestamp", "id")).alias("value"))), f"""
    WITH {PAIRS}, la AS (SELECT session_id, tool_name AS value FROM (SELECT *, row_number() OVER (PARTITION BY
    session_id ORDER BY timestamp DESC, id DESC) AS rn FROM tool_events) WHERE rn = 1)
    SELECT session_id, value, next, probability, rank, CASE next WHEN 'Read' THEN 'file_contents' WHEN 'Grep' THEN
    'search_index' WHEN 'Edit' THEN 'file_contents' WHEN 'Bash' THEN 'command_history' WHEN 'WebFetch' THEN 'url_cache'
    ELSE 'general' END AS prefetch FROM la JOIN tr ON value = previous WHERE probability > 0.1 AND rank <= 3""")
LAT = """lt AS (SELECT ms - lag(ms) OVER (ORDER BY ms, event_id) AS latency_ms FROM
         (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events {cut}))"""


def millis(b):
    return b.events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


query("f05_latency_first_100", lambda b: w.lag_latency(millis(b), "ms", "event_id", hi=300_000, first_n=100), f"""
    WITH {LAT.format(cut='ORDER BY ts, event_id LIMIT 100')} SELECT latency_ms FROM lt
    WHERE latency_ms > 0 AND latency_ms < 300000""")
query("f05_latency_all", lambda b: w.lag_latency(millis(b), "ms", "event_id", hi=5000), f"""
    WITH {LAT.format(cut='')} SELECT latency_ms FROM lt WHERE latency_ms > 0 AND latency_ms < 5000""")
query("f06_p95_latency", lambda b: w.rank_percentile(
    w.lag_latency(millis(b), "ms", "event_id", hi=300_000), "latency_ms", 0.95), f"""
    WITH {LAT.format(cut='')}, k AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS rn,
    count(*) OVER () AS n FROM lt WHERE latency_ms > 0 AND latency_ms < 300000)
    SELECT latency_ms AS value FROM k WHERE rn = least(CAST(floor(n * 0.95e0) AS BIGINT), n - 1)""")
query("f06_p95_price", lambda b: w.rank_percentile(b.lineitem, "l_extendedprice", 0.95), """
    WITH k AS (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS rn, count(*) OVER () AS n
               FROM lineitem)
    SELECT l_extendedprice AS value FROM k WHERE rn = least(CAST(floor(n * 0.95e0) AS BIGINT), n - 1)""")

DAILY = f"dl AS (SELECT {day('timestamp')} AS date, count(*) AS n FROM tool_events GROUP BY 1)"


def daily_volume(b):
    return t.daily_kinds(b.tool_events, since=1704067199)


query("f07_volume_trailing_7", lambda b: w.trailing_mean(
    daily_volume(b), "date", "total", 7).select("date", "total", rnd("trailing", 0).alias("trailing")), f"""
    WITH {DAILY} SELECT date, n AS total, {r('CAST(sum(n) OVER f AS DOUBLE) / count(n) OVER f')} AS trailing FROM dl
    WINDOW f AS (ORDER BY date ROWS 6 PRECEDING)""")
query("f08_score_trailing_null_skipping", lambda b: w.trailing_mean(
    t.daily_productivity(t.daily_kinds(b.tool_events, since=1704067199, end="2024-02-03")), "date", "score", 7)
    .select("date", rnd("trailing", 6).alias("trailing")), f"""
    WITH d AS (SELECT {day('timestamp')} AS date, {cif("tool_name IN ('Edit', 'Write')")} / CAST(nullif({cif(
        "tool_name IN ('Edit', 'Write', 'Read')")}, 0) AS DOUBLE) AS s FROM tool_events GROUP BY 1),
    sp AS (SELECT CAST(CAST(x AS DATE) AS VARCHAR) AS date FROM generate_series((SELECT min(CAST(date AS DATE)) FROM d),
           DATE '2024-02-03', INTERVAL 1 DAY) g(x))
    SELECT date, {r('sum(s) OVER f / count(s) OVER f', 6)} AS trailing FROM sp LEFT JOIN d USING (date)
    WINDOW f AS (ORDER BY date ROWS 6 PRECEDING)""")
query("f08_volume_strict_7", lambda b: w.trailing_mean(
    daily_volume(b), "date", "total", 7, strict=True).select("date", rnd("trailing", 6).alias("trailing")), f"""
    WITH {DAILY} SELECT date, CASE WHEN count(*) OVER f >= 7 THEN {r('CAST(sum(n) OVER f AS DOUBLE) / 7', 6)} END
    AS trailing FROM dl WINDOW f AS (ORDER BY date ROWS 6 PRECEDING)""")
query("f08_flow_trailing_10", lambda b: w.trailing_mean(
    b.flow_history.groupBy(day_of("timestamp").alias("date")).agg(exact_sum("score").alias("score")), "date",
    "score", 10).select("date", rnd("trailing", 4).alias("trailing")), f"""
    WITH d AS (SELECT {day('timestamp')} AS date, {dsum('score')} AS score FROM flow_history GROUP BY 1)
    SELECT date, {r('sum(score) OVER f / count(score) OVER f', 4)} AS trailing FROM d
    WINDOW f AS (ORDER BY date ROWS 9 PRECEDING)""")
query("f09_last_rows_calls", lambda b: w.last_rows_sum(daily_volume(b), "date", "total", (1, 7, 30)).select(
    *[F.col(f"last_{k}").cast("bigint").alias(f"last_{k}") for k in (1, 7, 30)]), f"""
    WITH {DAILY}, k AS (SELECT n, row_number() OVER (ORDER BY date DESC) AS rn FROM dl)
    SELECT {', '.join(f"CAST(sum(n) FILTER (WHERE rn <= {k}) AS BIGINT) AS last_{k}" for k in (1, 7, 30))} FROM k""")
query("f10_running_calls", lambda b: w.cumulative(daily_volume(b), "date", {"total": "running"}), f"""
    WITH {DAILY} SELECT date, row_number() OVER (ORDER BY date) AS row,
    CAST(sum(n) OVER (ORDER BY date) AS BIGINT) AS running FROM dl""")
query("f11_week_trend", lambda b: w.period_over_period(daily_volume(b), "date", "total", 7), f"""
    WITH {DAILY}, k AS (SELECT n, row_number() OVER (ORDER BY date DESC) AS rn FROM dl),
    s AS (SELECT CAST(sum(n) FILTER (WHERE rn <= 7) AS BIGINT) AS current,
          CAST(coalesce(sum(n) FILTER (WHERE rn BETWEEN 8 AND 14), 0) AS BIGINT) AS previous, count(*) AS c FROM k)
    SELECT current, previous, CASE WHEN c > 7 THEN (current - previous) * 1e2 / nullif(previous, 0) END AS change_pct
    FROM s""")
query("f14_peak_day", lambda b: w.arg_max(daily_volume(b), "total", ["date", "total"], ["date"]), f"""
    WITH {DAILY} SELECT date, n AS total FROM dl ORDER BY n DESC, date LIMIT 1""")
query("f14_latest_session_per_project", lambda b: w.arg_max(
    b.sessions, "started_at", ["id", "started_at"], ["id"], ["project_path"]), """
    SELECT project_path, id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY project_path
    ORDER BY started_at DESC, id) AS rn FROM sessions) WHERE rn = 1""")
SEC_DAY = "2024-01-28"
query("f16_section_lines", lambda b: w.section_lines(b.log_lines, "id", "line", "SESSION", SEC_DAY, most=200), f"""
    WITH bo AS (SELECT id, trim(line) AS line FROM log_lines WHERE trim(line) <> ''),
    op AS (SELECT max(id) AS o FROM bo WHERE line LIKE '%SESSION%' AND line LIKE '%{SEC_DAY}%'),
    cl AS (SELECT min(id) AS c FROM bo, op WHERE id > o AND line LIKE '%SESSION%'),
    se AS (SELECT id, line FROM bo, op, cl WHERE id > o AND (c IS NULL OR id < c) ORDER BY id DESC LIMIT 200)
    SELECT * FROM se UNION ALL SELECT * FROM (SELECT id, line FROM bo WHERE (SELECT count(*) FROM se) = 0
    ORDER BY id DESC LIMIT 200)""")
query("f17_hour_spread", lambda b: w.spread(
    daily_volume(b).select("date", "total"), "date", "total", t.hourly_calls(b.tool_events, as_of=NOW, days=400),
    "hour", "calls"), f"""
    WITH {DAILY}, h AS (SELECT {hour('timestamp')} AS hour, count(*) AS c FROM tool_events GROUP BY 1),
    tt AS (SELECT sum(c) AS s FROM h)
    SELECT date, hour, CAST(floor(CAST(n * c AS DOUBLE) / s) AS BIGINT) AS part FROM dl, h, tt""")
query("f18_first_text", lambda b: w.first_value(
    b.turns.filter("type = 'user'"), "session_id", "text", ["timestamp", "turn"], cuts={"title": 50, "intent": 80}), """
    SELECT session_id, substr(text, 1, 50) AS title, substr(text, 1, 80) AS intent FROM (SELECT *, row_number() OVER
    (PARTITION BY session_id ORDER BY timestamp, turn) AS rn FROM turns WHERE type = 'user' AND length(text) >= 4)
    WHERE rn = 1""")
query("f19_days_touched", lambda b: w.days_touched(b.self_heal_events, day_of("timestamp")), f"""
    SELECT count(*) AS n, count(DISTINCT {day('timestamp')}) AS days,
           CAST(count(*) AS DOUBLE) / count(DISTINCT {day('timestamp')}) AS per_day FROM self_heal_events""")


# ---- sketches in rollups ----------------------------------------------------------

def sketched_p95(b):
    """Sketch of each tool and day, merged over all days, against the exact rank of the value it gives."""
    rollup = sketches.quantile_rollup(b.tool_events, "tool_name", day_of("timestamp"), "duration_ms")
    found = sketches.quantiles(rollup, "tool_name", [0.95]).select("tool_name", "n", F.col("q")[0].alias("q"))
    ranks = b.tool_events.filter("duration_ms IS NOT NULL").join(found, "tool_name").groupBy("tool_name", "n").agg(
        (F.count_if(F.col("duration_ms") < F.col("q")) / F.col("n")).alias("below"),
        (F.count_if(F.col("duration_ms") <= F.col("q")) / F.col("n")).alias("up_to"))
    e = sketches.RANK_ERROR
    return ranks.select("tool_name", "n", ((F.col("below") <= 0.95 + e) & (F.col("up_to") >= 0.95 - e)).alias("within"))


query("f06_p95_rollup", sketched_p95, """
    SELECT tool_name, count(*) AS n, true AS within FROM tool_events WHERE duration_ms IS NOT NULL GROUP BY 1""")
query("e36_trailing_distinct", lambda b: sketches.trailing_distinct(
    sketches.distinct_rollup(b.tool_events, day_of("timestamp"), "session_id"), 7), f"""
    WITH d AS (SELECT DISTINCT CAST({day('timestamp')} AS DATE) AS d, session_id FROM tool_events)
    SELECT CAST(o.d AS VARCHAR) AS day, count(DISTINCT session_id) AS n FROM (SELECT DISTINCT d FROM d) o
    JOIN d ON d.d BETWEEN o.d - 6 AND o.d GROUP BY 1""")
