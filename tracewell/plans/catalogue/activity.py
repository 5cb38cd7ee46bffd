"""Commands, coordination, repositories, CRM, memory, recovery, errors, logs."""

from pyspark.sql import functions as F

from tracewell.functions.exprs import datetime_of
from tracewell.operators import coordination as co
from tracewell.operators import crm, memory
from tracewell.operators import health as h
from tracewell.operators import recovery as rc
from tracewell.operators.joins import due_soon
from tracewell.plans.registry import EVENTS_DAY as TODAY
from tracewell.plans.registry import EVENTS_NOW as NOW
from tracewell.plans.registry import LINES_NOW, avg, cif, day, dsum, fixed, hour, isum, pct, query, r
from tracewell.sources.logs import WATCHDOG_PATTERNS, parse_log

CMD = """CASE WHEN lower(command) IN ('co', 'opus') THEN 'opus' WHEN lower(command) IN ('cc', 'sonnet') THEN 'sonnet'
         WHEN lower(command) IN ('cq', 'haiku') THEN 'haiku' ELSE 'other' END"""
query("e56_command_models", lambda b: co.command_models(b.command_events),
      f"SELECT {CMD} AS model, count(*) AS n FROM command_events GROUP BY 1")
query("e57_top_commands", lambda b: co.top_commands(b.command_events), f"""
    SELECT command, count(*) AS n, {r(avg('execution_time_ms'))} AS avg_ms FROM command_events WHERE command <> ''
    GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15""")
query("e58_command_daily", lambda b: co.command_daily(b.command_events), f"""
    SELECT {day('timestamp')} AS day, count(*) AS total, {cif("lower(command) IN ('co', 'opus')")} AS opus,
           {cif("lower(command) IN ('cc', 'sonnet')")} AS sonnet, {cif("lower(command) IN ('cq', 'haiku')")} AS haiku
    FROM command_events GROUP BY 1""")
query("e59_command_totals", lambda b: co.command_totals(b.command_events), f"""
    SELECT count(*) AS total_commands, count(DISTINCT command) AS unique_commands,
           count(DISTINCT {day('timestamp')}) AS active_days FROM command_events""")
DONE, FAIL = cif("action = 'complete'"), cif("action = 'fail'")
query("e60_coordinator_by_strategy", lambda b: co.by_strategy(b.coordinator_events), f"""
    SELECT coalesce(nullif(strategy, ''), 'unnamed') AS strategy, count(*) AS total, {DONE} AS completed,
           {FAIL} AS failed, {cif("action = 'timeout'")} AS timed_out, {r(avg('duration_ms'))} AS avg_duration_ms
    FROM coordinator_events GROUP BY 1""")
query("e60_coordinator_by_action", lambda b: co.by_action(b.coordinator_events),
      "SELECT action, count(*) AS n FROM coordinator_events GROUP BY 1")
query("e60_coordinator_daily", lambda b: co.coordinator_daily(b.coordinator_events), f"""
    SELECT {day('timestamp')} AS day, count(*) AS total, {DONE} AS completed, {FAIL} AS failed
    FROM coordinator_events GROUP BY 1""")
query("e60_coordinator_totals", lambda b: co.coordinator_totals(b.coordinator_events), f"""
    SELECT count(*) AS total_events, count(DISTINCT agent_id) AS unique_agents, {DONE} AS total_completed,
           {FAIL} AS total_failed, {pct(DONE, 'count(*)')} AS success_rate FROM coordinator_events""")
query("g01_c12_i04_coordinator_recent", lambda b: co.coordinator_recent(b.coordinator_events), """
    SELECT id, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') AS time, agent_id, action, strategy,
           duration_ms, exit_code, substr(result, 1, 80) AS result_preview
    FROM coordinator_events ORDER BY timestamp DESC, id DESC LIMIT 15""")
query("e61_agent_registry", lambda b: co.agent_registry(b.agents), """
    SELECT 'state' AS dimension, coalesce(state, 'unknown') AS value, count(*) AS agents FROM agents GROUP BY 2
    UNION ALL SELECT 'model', coalesce(model, 'unknown'), count(*) FROM agents GROUP BY 2""")
query("e61_agent_totals", lambda b: co.agent_totals(b.agents), f"""
    SELECT count(*) AS total_agents, {cif("state IN ('pending', 'running')")} AS active,
           {dsum('cost_estimate')} AS total_cost FROM agents""")
query("e62_lock_totals", lambda b: co.lock_totals(b.locks), f"""
    SELECT count(*) AS total_locks, {cif("lock_type = 'read'")} AS read_locks,
           count(*) - {cif("lock_type = 'read'")} AS write_locks, count(DISTINCT path) AS files_locked,
           count(DISTINCT agent_id) AS agents_with_locks FROM locks""")
G100 = "g AS (SELECT * FROM git_events ORDER BY timestamp DESC, id DESC LIMIT 100)"
GIT_NOW = LINES_NOW - 92 * 86400 + 3600   # one hour into 2001-08-01, the last order date
GITQ = f"""SELECT count(*) AS total, {cif(f'timestamp >= {GIT_NOW - 3600}')} AS today,
           {cif(f'timestamp >= {GIT_NOW - 7 * 86400}')} AS week, {isum('additions')} AS insertions,
           {isum('deletions')} AS deletions FROM"""
query("e63_t13_git_stats", lambda b: co.git_stats(b.git_events, as_of=GIT_NOW, last_n=100), f"WITH {G100} {GITQ} g")
query("e63_git_stats_all", lambda b: co.git_stats(b.git_events, as_of=GIT_NOW, last_n=None), f"{GITQ} git_events")
query("e63_git_by_repo", lambda b: co.git_by_repo(b.git_events, last_n=100),
      f"WITH {G100} SELECT repo, count(*) AS n FROM g GROUP BY 1")
query("e63_git_by_repo_all", lambda b: co.git_by_repo(b.git_events), "SELECT repo, count(*) AS n FROM git_events GROUP BY 1")
query("e64_git_daily", lambda b: co.git_daily(b.since(GIT_NOW - 30 * 86400).git_events, as_of=GIT_NOW), f"""
    SELECT {day('timestamp')} AS date, count(*) AS commits FROM git_events WHERE timestamp > {GIT_NOW - 30 * 86400}
    GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
query("e64_top_authors", lambda b: co.top_authors(b.git_events), """
    SELECT author, count(*) AS commits FROM git_events WHERE author IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1
    LIMIT 5""")
query("e65_most_changed_files", lambda b: co.most_changed(b.file_changes), """
    SELECT project, file, count(*) AS n FROM file_changes WHERE file LIKE '%.%' AND file LIKE '%/%'
    AND regexp_extract(file, '([^.]*)$', 1) IN ('ts', 'tsx', 'js', 'jsx', 'py', 'sh', 'json', 'md')
    GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15""")

# ---- CRM -------------------------------------------------------------------
query("e66_crm_stats", lambda b: crm.stats(b.crm_contacts, b.crm_deals, b.crm_interactions, as_of=TODAY), f"""
    SELECT 'total_contacts' AS metric, CAST(count(*) AS DOUBLE) AS value FROM crm_contacts
    UNION ALL SELECT 'active_deals', count(*) FROM crm_deals WHERE stage NOT IN ('won', 'lost')
    UNION ALL SELECT 'pipeline_value', {dsum('value')} FROM crm_deals WHERE stage NOT IN ('won', 'lost')
    UNION ALL SELECT 'won_deals', count(*) FROM crm_deals WHERE stage = 'won'
    UNION ALL SELECT 'total_interactions', count(*) FROM crm_interactions
    UNION ALL SELECT 'follow_ups_due', count(*) FROM crm_interactions
              WHERE follow_up IS NOT NULL AND follow_up_date <= '2024-02-07'""")
query("d02_contact_activity", lambda b: crm.contact_activity(b.crm_contacts, b.crm_deals, b.crm_interactions), """
    SELECT c.*, (SELECT count(*) FROM crm_deals d WHERE d.contact_id = c.id) AS deals,
           (SELECT count(*) FROM crm_interactions i WHERE i.contact_id = c.id) AS interactions FROM crm_contacts c""")
query("d03_deals_with_contact", lambda b: crm.deals_with_contact(b.crm_deals, b.crm_contacts), """
    SELECT d.*, c.name AS contact_name FROM crm_deals d LEFT JOIN crm_contacts c ON c.id = d.contact_id""")
query("g04_deal_board", lambda b: crm.deal_board(b.crm_deals, b.crm_contacts), """
    SELECT d.*, CAST(CASE stage WHEN 'prospect' THEN 1 WHEN 'contacted' THEN 2 WHEN 'meeting' THEN 3 WHEN 'proposal'
           THEN 4 WHEN 'negotiation' THEN 5 WHEN 'won' THEN 6 WHEN 'lost' THEN 7 END AS BIGINT) AS position,
           c.name AS contact_name FROM crm_deals d LEFT JOIN crm_contacts c ON c.id = d.contact_id
    ORDER BY position, d.updated_at DESC, d.id LIMIT 50""")
query("d03_recent_interactions", lambda b: crm.recent_interactions(b.crm_interactions, b.crm_contacts), """
    SELECT i.*, c.name AS contact_name FROM crm_interactions i LEFT JOIN crm_contacts c ON c.id = i.contact_id
    ORDER BY i.created_at DESC, i.id DESC LIMIT 20""")
query("d04_c08_follow_ups_due", lambda b: due_soon(
    b.crm_interactions, b.crm_contacts, 7, as_of="2024-01-20"), """
    SELECT name, company, follow_up, follow_up_date, type FROM crm_interactions i JOIN crm_contacts c
    ON c.id = i.contact_id WHERE follow_up IS NOT NULL AND follow_up_date <= '2024-01-27'""")
query("e67_crm_categories", lambda b: crm.categories(b.crm_contacts),
      "SELECT category, count(*) AS n FROM crm_contacts GROUP BY 1")

# ---- memory ----------------------------------------------------------------
query("e68_store_totals", lambda b: memory.store_totals(
    memory_items=b.memory_items, learnings=b.learnings, error_patterns=b.error_patterns, reviews=b.reviews), """
    SELECT 'memory_items' AS store, count(*) AS n FROM memory_items UNION ALL SELECT 'learnings', count(*)
    FROM learnings UNION ALL SELECT 'error_patterns', count(*) FROM error_patterns
    UNION ALL SELECT 'reviews', count(*) FROM reviews""")
query("e68_memory_by_project", lambda b: memory.by_project(b.memory_items),
      "SELECT project, count(*) AS n FROM memory_items WHERE project IS NOT NULL GROUP BY 1")
query("e68_memory_by_source", lambda b: memory.by_source(b.memory_items),
      "SELECT source, count(*) AS n FROM memory_items GROUP BY 1")
query("e68_learnings_by_category", lambda b: memory.by_category(b.learnings),
      "SELECT category, count(*) AS n FROM learnings GROUP BY 1")
query("e69_memory_growth", lambda b: memory.daily_growth(b.memory_items, "created_at", as_of=TODAY), """
    SELECT created_at AS date, count(*) AS n FROM memory_items WHERE created_at >= '2024-01-01' GROUP BY 1""")
query("e69_learning_growth", lambda b: memory.daily_growth(b.learnings, "date", as_of=TODAY), """
    SELECT date, count(*) AS n FROM learnings WHERE date >= '2024-01-01' GROUP BY 1""")
DUE = cif(f"next_review <= '{TODAY}'")
query("e70_review_queue", lambda b: memory.review_queue(b.reviews, as_of=TODAY), f"""
    SELECT category, count(*) AS total, {DUE} AS due, count(*) - {DUE} AS upcoming FROM reviews GROUP BY 1
    UNION ALL SELECT '*', count(*), {DUE}, count(*) - {DUE} FROM reviews""")
query("g11_due_items", lambda b: memory.due_items(b.reviews, as_of=TODAY), f"""
    SELECT * FROM reviews WHERE next_review <= '{TODAY}' ORDER BY next_review, id LIMIT 10""")
query("g11_recent_notes", lambda b: memory.recent_notes(b.learnings), """
    SELECT id, category, project, date FROM learnings ORDER BY date DESC, id LIMIT 10""")
query("g02_top_error_patterns", lambda b: memory.top_error_patterns(b.error_patterns), """
    SELECT * FROM error_patterns ORDER BY count DESC, category, pattern LIMIT 8""")
TAGS = """t AS (SELECT type, unnest(string_split(tag_text, ',')) AS tag FROM knowledge)"""
K3 = ", ".join(f"{cif(f'type = {chr(39)}{k}{chr(39)}')} AS {k}" for k in memory.KNOWLEDGE_TYPES)
query("e71_tag_counts", lambda b: memory.tag_counts(b.knowledge, F.split("tag_text", ",")), f"""
    WITH {TAGS} SELECT tag, count(*) AS n, {K3}, (SELECT count(DISTINCT tag) FROM t) AS unique_tags FROM t GROUP BY 1
    ORDER BY n DESC, tag LIMIT 12""")
query("e72_monthly_growth", lambda b: memory.monthly_growth(b.knowledge),
      f"SELECT substr(timestamp, 1, 7) AS month, {K3} FROM knowledge GROUP BY 1")
query("e73_portfolio", lambda b: memory.portfolio(b.project_files), f"""
    SELECT count(DISTINCT project) AS projects, {isum('files')} AS files, {isum('lines')} AS lines
    FROM project_files""")
query("e73_file_types", lambda b: memory.file_types(b.project_files.groupBy("project").agg(
    F.map_from_entries(F.collect_list(F.struct("ext", "files"))).alias("file_types")), "file_types"),
      f"SELECT ext, {isum('files')} AS files FROM project_files GROUP BY 1")
query("g07_largest_projects", lambda b: memory.largest_projects(b.project_files), f"""
    SELECT project, {isum('lines')} AS lines FROM project_files GROUP BY 1 HAVING sum(lines) > 0
    ORDER BY 2 DESC, 1 LIMIT 10""")
query("e74_pack_types", lambda b: memory.pack_types(b.packs), "SELECT type, count(*) AS n FROM packs GROUP BY 1")
PATS = ("implementation", "research", "testing", "review", "debugging")
PCOLS = ", ".join(f"{cif(f'pattern = {chr(39)}{p}{chr(39)}')} AS {p}" for p in PATS)
query("e75_pattern_weekly", lambda b: memory.pattern_matrix(
    b.pattern_log, F.trunc(F.col("date").cast("date"), "week").cast("string"), PATS, 8), f"""
    SELECT CAST(CAST(date_trunc('week', CAST(date AS DATE)) AS DATE) AS VARCHAR) AS bucket, {PCOLS} FROM pattern_log
    GROUP BY 1 ORDER BY 1 DESC LIMIT 8""")
query("e75_pattern_daily", lambda b: memory.pattern_matrix(b.pattern_log, F.col("date"), PATS, 21),
      f"SELECT date AS bucket, {PCOLS} FROM pattern_log GROUP BY 1 ORDER BY 1 DESC LIMIT 21")
WORDS = "the and with"
query("l26_search", lambda b: memory.search(
    b.documents.withColumnRenamed("lang", "category"), WORDS, id_col="doc_id", text="text", category="en", limit=20),
      f"""SELECT doc_id, source, category, sim AS similarity FROM (SELECT doc_id, source, lang AS category,
          len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')),
          ['the', 'and', 'with'])) / 3e0 AS sim FROM documents WHERE lang = 'en') WHERE sim > 0
          ORDER BY sim DESC, doc_id LIMIT 20""")
query("l26_search_sources", lambda b: memory.hits_by_source(memory.search(
    b.documents.withColumnRenamed("lang", "category"), WORDS, id_col="doc_id", text="text", limit=50)),
      """SELECT source, count(*) AS n FROM (SELECT doc_id, source, len(list_intersect(list_distinct(
          regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')), ['the', 'and', 'with'])) / 3e0 AS sim
          FROM documents ORDER BY sim DESC, doc_id LIMIT 50) WHERE sim > 0 GROUP BY 1""")


def _similar(b):
    probe = b.embeddings.filter("vec_id = 0").select("embedding").scalar()
    hits = memory.similar_vectors(b.embeddings, probe, id_col="vec_id", vec="embedding", limit=10)
    return hits.select("vec_id", F.round("similarity", 5).alias("similarity"))


query("l26_similar_vectors", _similar, """
    WITH q AS (SELECT embedding AS p FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT p FROM q) AS DOUBLE[])), 5)
           AS similarity FROM embeddings
    ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT p FROM q) AS DOUBLE[])) DESC, vec_id
    LIMIT 10""")

# ---- recovery --------------------------------------------------------------


def both(n):
    lim = f"ORDER BY timestamp DESC, id DESC LIMIT {n}" if n else ""
    return f"""bt AS ((SELECT error_pattern AS category, coalesce(fix_applied, error_pattern) AS action,
        timestamp AS ts, success, CAST(1 AS BIGINT) AS auto FROM self_heal_events {lim})
        UNION ALL (SELECT error_type, coalesce(recovery_strategy, error_type), timestamp, success, 0
        FROM recovery_events {lim}))"""


OK = cif("success = 1")
AUTO = cif("auto = 1 AND success = 1")
query("e76_recovery_stats", lambda b: rc.stats(b.self_heal_events, b.recovery_events, last_n=100), f"""
    WITH {both(100)} SELECT count(*) AS total, {AUTO} AS auto_fix, {pct(AUTO, 'count(*)')} AS auto_fix_rate,
    {pct(OK, 'count(*)')} AS success_rate FROM bt""")
query("e76_recovery_stats_all", lambda b: rc.stats(b.self_heal_events, b.recovery_events, last_n=None), f"""
    WITH {both(0)} SELECT count(*) AS total, {AUTO} AS auto_fix, {pct(AUTO, 'count(*)')} AS auto_fix_rate,
    {pct(OK, 'count(*)')} AS success_rate FROM bt""")
query("e77_recovery_by_category", lambda b: rc.by_category(b.self_heal_events, b.recovery_events, last_n=None), f"""
    WITH {both(0)} SELECT category, count(*) AS n, {OK} AS success, {pct(OK, 'count(*)')} AS success_pct FROM bt
    GROUP BY 1""")
query("g06_h01_recent_actions", lambda b: rc.recent_actions(b.self_heal_events, b.recovery_events), f"""
    WITH {both(10)} SELECT action, category, ts, success, auto FROM bt""")
query("e78_t09_t10_recovery_timeline", lambda b: rc.timeline(b.self_heal_events, as_of=NOW, last_n=None), f"""
    SELECT {day('timestamp')} AS day, strftime(CAST({day('timestamp')} AS DATE), '%m/%d') AS label, {OK} AS auto_fix,
           {cif('success = 0')} AS suggested FROM self_heal_events
    WHERE ({NOW} - timestamp) // 86400 <= 7 GROUP BY 1, 2""")
query("e79_recovery_by", lambda b: rc.totals_by(b.recovery_events), """
    SELECT 'type' AS dimension, error_type AS value, count(*) AS n FROM recovery_events GROUP BY 2
    UNION ALL SELECT 'method', coalesce(recovery_method, 'unknown'), count(*) FROM recovery_events GROUP BY 2""")
query("e79_recovery_totals", lambda b: rc.totals(b.recovery_events),
      f"SELECT count(*) AS total, {isum('success')} AS successful FROM recovery_events")
query("e80_recovery_log", lambda b: rc.log_stats(b.recovery_log), f"""
    SELECT count(*) AS total, {OK} AS success, {cif('success = 0')} AS failed, {pct(OK, 'count(*)')} AS success_rate
    FROM recovery_log""")
query("e80_a15_recovery_patterns", lambda b: rc.log_patterns(b.recovery_log), """
    SELECT coalesce(nullif(pattern, ''), nullif(category, ''), 'unknown') AS pattern, count(*) AS n FROM recovery_log
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
query("e87_effectiveness", lambda b: rc.effectiveness(b.recovery_log), f"""
    SELECT action, count(*) AS total, {OK} AS success, {r(pct(OK, 'count(*)', 6))} AS rate,
           CASE WHEN {OK} * 1e2 / count(*) >= 80 THEN 'good' WHEN {OK} * 1e2 / count(*) >= 50 THEN 'fair'
           ELSE 'poor' END AS band FROM recovery_log GROUP BY 1""")
query("e81_error_types", lambda b: rc.error_types(b.error_log), """
    SELECT coalesce(nullif(type, ''), nullif(category, ''), 'unknown') AS type, count(*) AS n FROM error_log GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 10""")
query("e81_error_total", lambda b: rc.error_total(b.error_log), "SELECT count(*) AS total_errors FROM error_log")
query("e81_first_errors", lambda b: rc.first_errors(b.error_log), """
    SELECT coalesce(nullif(type, ''), nullif(category, ''), 'unknown') AS type, substr(message, 1, 100) AS message, ts,
           coalesce(severity, 'unknown') AS severity FROM error_log ORDER BY ts, id LIMIT 10""")
query("e82_activity_by_type", lambda b: rc.activity_by_type(b.since(NOW - 7 * 86400).activity_events, as_of=NOW), f"""
    SELECT event_type, count(*) AS n FROM activity_events WHERE timestamp > {NOW - 7 * 86400} GROUP BY 1""")
query("e82_activity_top_types", lambda b: rc.activity_top_types(b.activity_events), """
    SELECT event_type, count(*) AS n FROM activity_events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
query("e82_activity_last_days", lambda b: rc.activity_last_days(b.activity_events), f"""
    SELECT {day('timestamp')} AS date, count(*) AS n FROM activity_events GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
query("e83_activity_hourly", lambda b: rc.activity_hourly(b.since(NOW - 7 * 86400).activity_events, as_of=NOW), f"""
    SELECT strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:00:00') AS hour, count(*) AS event_count
    FROM activity_events WHERE timestamp > {NOW - 7 * 86400} GROUP BY 1""")
query("e84_watchdog_daily", lambda b: rc.log_daily(b.log_lines), f"""
    SELECT substr(line, 2, 10) AS date, {cif("line LIKE '%DOWN:%'")} AS down, {cif("line LIKE '%LOADED%'")} AS loaded,
           {cif("line LIKE '%HEALED%'")} AS healed FROM log_lines WHERE line LIKE '[%' GROUP BY 1""")
query("e84_heals_by_service", lambda b: rc.heals_by_service(b.log_lines, "svc."), """
    SELECT replace(trim(regexp_extract(line, 'LOADED(.*)$', 1)), 'svc.', '') AS service, count(*) AS heals
    FROM log_lines WHERE line LIKE '%LOADED%' GROUP BY 1""")
query("e85_heal_daily", lambda b: rc.heal_daily(b.heal_runs), f"""
    SELECT {day('ts')} AS date, {isum('ok')} AS ok, {isum('warn')} AS warn, {isum('error')} AS error,
           {isum('fixed')} AS fixed, count(*) AS runs FROM heal_runs GROUP BY 1""")
query("e85_heal_summary", lambda b: rc.heal_summary(b.heal_runs), f"""
    SELECT count(*) AS total_runs, {isum('fixed')} AS total_fixed, {isum('ok + warn + error')} AS total_checks,
           {isum('warn')} AS total_warn, {isum('error')} AS total_error FROM heal_runs""")


def healing(b):
    """Healing events read from log lines, with their instants back as epochs."""
    p = parse_log(b.log_lines, WATCHDOG_PATTERNS)
    return p.withColumn("success", (F.col("action") != "detected").cast("bigint")).withColumn(
        "ts", F.unix_timestamp(F.to_timestamp("ts")))


PARSED = r"""pl AS (SELECT id, substr(line, 2, 19) AS ts, CASE WHEN line LIKE '%LOADED%' THEN 'reload'
    WHEN line LIKE '%DOWN:%' THEN 'detected' WHEN line LIKE '%HEALED%' THEN 'heal' END AS action,
    CASE WHEN line LIKE '%LOADED%' THEN regexp_extract(line, 'LOADED (.*)$', 1)
    WHEN line LIKE '%DOWN:%' THEN regexp_extract(line, 'DOWN: (.*)$', 1) ELSE 'watchdog' END AS subject,
    CASE WHEN line LIKE '%LOADED%' THEN 'Reloaded ' || regexp_extract(line, 'LOADED (.*)$', 1)
    WHEN line LIKE '%DOWN:%' THEN 'Detected ' || regexp_extract(line, 'DOWN: (.*)$', 1) || ' down'
    ELSE 'Healed ' || regexp_extract(line, 'HEALED (\d+)', 1) || ' daemon(s)' END AS message FROM log_lines
    WHERE line LIKE '[%' AND (line LIKE '%LOADED%' OR line LIKE '%DOWN:%' OR line LIKE '%HEALED%'))"""
query("a08_i19_parse_log", lambda b: parse_log(b.log_lines, WATCHDOG_PATTERNS).select(
    "id", "ts", "action", "subject", "message"), f"WITH {PARSED} SELECT id, ts, action, subject, message FROM pl")
E_TS = "CAST(epoch_us(CAST(ts AS TIMESTAMP)) // 1000000 AS BIGINT)"
query("e86_healing_kpis", lambda b: rc.healing_kpis(healing(b), as_of=NOW - 3600), f"""
    WITH {PARSED}, k AS (SELECT *, {E_TS} AS e FROM pl)
    SELECT count(*) AS total, {cif("e >= 1706572800")} AS today, {cif(f'e > {NOW - 3600 - 86400}')} AS last_24h,
           {r('CAST(count(*) AS DOUBLE) / count(DISTINCT substr(ts, 1, 10))', 1)} AS avg_per_day,
           {cif("action = 'reload'")} AS reload_ok, 1e2 AS reload_success FROM k""")
query("h02_healing_events", lambda b: rc.healing_events(parse_log(b.log_lines, WATCHDOG_PATTERNS), b.heal_runs), f"""
    WITH {PARSED} SELECT ts AS timestamp, subject AS service, action, CASE WHEN action = 'detected' THEN CAST(0 AS BIGINT) ELSE 1 END
    AS success, message FROM pl UNION ALL SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S'),
    'self-heal', 'deep-heal', 1, 'Deep heal fixed ' || fixed || ' issue(s)' FROM heal_runs WHERE fixed > 0""")
query("e89_risky_hours", lambda b: rc.risky_hours(b.heal_runs), f"""
    SELECT {hour('ts')} AS hour, count(*) AS n FROM heal_runs WHERE warn > 0 OR error > 0 GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 3""")
query("e89_t17_fix_effectiveness", lambda b: rc.fix_effectiveness(b.heal_runs), f"""
    SELECT {cif('fixed > 0')} AS runs_with_fixes, CAST(sum(fixed) FILTER (WHERE fixed > 0) AS DOUBLE) /
           {cif('fixed > 0')} AS effectiveness FROM heal_runs""")
query("e90_flow_stats", lambda b: rc.flow_stats(b.flow_history),
      f"SELECT count(*) AS measurements, {r(avg('score'), 3)} AS avg_flow FROM flow_history")
query("e90_flow_peak_hours", lambda b: rc.flow_peak_hours(b.flow_history), f"""
    SELECT {hour('timestamp')} AS hour, count(*) AS n FROM flow_history WHERE score > 0.5 GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 5""")
query("e99_permission_events", lambda b: rc.permission_prompts(b.autonomy_events), f"""
    SELECT {cif("event_type = 'permission_prompt'")} AS permission_events FROM autonomy_events""")
query("e103_marker_ratio", lambda b: rc.marker_ratio(b.log_lines, "HEALED"), f"""
    SELECT count(*) AS lines, {pct(cif("line LIKE '%HEALED%'"), 'count(*)')} AS marked_pct FROM log_lines""")
query("e103_array_sizes", lambda b: rc.array_sizes(b.knowledge.select("id", F.split("tag_text", ",").alias("tags")),
                                                   n_tags="tags").groupBy("n_tags").agg(F.count(F.lit(1)).alias("n")),
      "SELECT CAST(len(string_split(tag_text, ',')) AS BIGINT) AS n_tags, count(*) AS n FROM knowledge GROUP BY 1")

# ---- health ----------------------------------------------------------------
CHECKS = """ck AS (SELECT error_pattern AS category, CASE WHEN severity = 'high' AND success = 0 THEN 'error'
            WHEN success = 0 THEN 'warn' ELSE 'ok' END AS status FROM self_heal_events)"""
query("e88_check_report", lambda b: h.check_report(b.self_heal_events.select(
    F.col("error_pattern").alias("category"), F.expr("CASE WHEN severity = 'high' AND success = 0 THEN 'error' "
                                                     "WHEN success = 0 THEN 'warn' ELSE 'ok' END").alias("status"))),
      f"""WITH {CHECKS}, a AS (SELECT * FROM ck UNION ALL SELECT '*', status FROM ck),
      c AS (SELECT category, {', '.join(f"{cif(f'status = {chr(39)}{x}{chr(39)}')} AS {x}" for x in
                                        ('ok', 'warn', 'error'))} FROM a GROUP BY 1)
      SELECT *, ok + warn + error AS total, CASE WHEN error = 0 AND warn = 0 THEN 'HEALTHY' WHEN error = 0
             THEN 'DEGRADED' ELSE 'UNHEALTHY' END AS verdict FROM c""")
query("l13_anomalies", lambda b: h.anomalies(b.heal_runs, baseline=5.0), f"""
    SELECT {day('ts')} AS date, {isum('fixed')} AS value, 5e0 AS baseline, 'warning' AS severity
    FROM heal_runs GROUP BY 1 HAVING sum(fixed) > 15""")
ADVICE = f"""s AS (SELECT count(*) AS runs, {cif('fixed > 0')} AS fixing FROM t)
    SELECT runs, fixing, CAST(fixing AS DOUBLE) / runs AS fix_rate, CASE WHEN runs < 10 THEN 'none'
           WHEN CAST(fixing AS DOUBLE) / runs > 0.8 THEN 'tighten_thresholds'
           WHEN CAST(fixing AS DOUBLE) / runs < 0.1 THEN 'loosen_thresholds' ELSE 'none' END AS suggestion FROM s"""
query("l14_threshold_advice", lambda b: h.threshold_advice(b.heal_runs, 100),
      f"WITH t AS (SELECT * FROM heal_runs ORDER BY ts DESC, id DESC LIMIT 100), {ADVICE}")
query("l14_threshold_advice_all", lambda b: h.threshold_advice(b.heal_runs), f"WITH t AS (SELECT * FROM heal_runs), {ADVICE}")


def growth(b):
    daily = b.activity_events.groupBy(F.col("event_type").alias("name"), F.substring(
        datetime_of("timestamp"), 1, 10).alias("date")).agg(F.count(F.lit(1)).alias("size"))
    return h.growth_alerts(daily, max_per_day=6.0)


GROW = f"""gr AS (SELECT name, CAST(sum(size) AS BIGINT) AS size, greatest(date_diff('day', min(CAST(date AS DATE)),
    max(CAST(date AS DATE))), 1) AS age_days FROM (SELECT event_type AS name, {day('timestamp')} AS date,
    count(*) AS size FROM activity_events GROUP BY 1, 2) GROUP BY 1),
    ga AS (SELECT *, CAST(size AS DOUBLE) / age_days AS per_day FROM gr WHERE CAST(size AS DOUBLE) / age_days > 6)"""
query("l15_growth_alerts", growth, f"WITH {GROW} SELECT * FROM ga")


def risk_hour(b):
    return h.issue_predictions(rc.risky_hours(b.heal_runs, 24), growth(b), 3)


query("h03_t18_issue_predictions", risk_hour, f"""
    WITH {GROW}, rh AS (SELECT {hour('ts')} AS hour, count(*) AS n FROM heal_runs WHERE warn > 0 OR error > 0
                        GROUP BY 1)
    SELECT 'time_risk' AS type, 0.7e0 AS confidence, 'Hour ' || hour || ' historically has issues' AS message,
           'preemptive_check' AS action FROM rh WHERE hour = 3
    UNION ALL SELECT 'log_growth', 0.8e0, name || ' growing at ' || CAST(CAST(floor(per_day * 10 + 0.5) AS BIGINT) // 10
           AS VARCHAR) || '.' || CAST(CAST(floor(per_day * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) || ' per day',
           'schedule_rotation' FROM ga""")


def fresh(b):
    return {"tool_events": (b.tool_events, "timestamp", 1.0), "activity_events": (b.activity_events, "timestamp", 0.01),
            "git_events": (b.git_events, "timestamp", 24.0)}


_AGES = " UNION ALL ".join(
    f"SELECT '{n}' AS name, {m}e0 AS max_hours, ({NOW} - max(timestamp)) / 3600e0 AS a FROM {n}"
    for n, m in (("tool_events", 1.0), ("activity_events", 0.01), ("git_events", 24.0)))
query("l16_i22_dataset_freshness", lambda b: h.dataset_freshness(fresh(b), as_of=NOW), f"""
    SELECT name, max_hours, {r('a', 2)} AS hours, CASE WHEN a < 1 THEN CAST(CAST(floor(a * 60) AS BIGINT) AS VARCHAR)
           || 'm ago' WHEN a < 24 THEN {fixed('a', 1)} || 'h ago' ELSE {fixed('a / 24', 1)} || 'd ago' END AS age,
           CASE WHEN a <= max_hours THEN 'ok' ELSE 'warn' END AS status FROM ({_AGES})""")
query("j09_freshness_gauge", lambda b: h.stream_freshness(b.activity_events, "timestamp", as_of=NOW), f"""
    WITH a AS (SELECT {r(f'({NOW} - max(timestamp)) / 60e0', 1)} AS age_minutes FROM activity_events)
    SELECT age_minutes, CASE WHEN age_minutes BETWEEN 0 AND 60 THEN 'fresh' WHEN age_minutes BETWEEN 0 AND 1440
           THEN 'stale' ELSE 'offline' END AS freshness FROM a""")
VALID = "json_valid(line)"
query("l17_jsonl_health", lambda b: h.jsonl_health(b.json_lines), f"""
    WITH j AS (SELECT {cif(VALID)} AS valid, {cif(f'NOT {VALID}')} AS invalid FROM json_lines WHERE trim(line) <> '')
    SELECT valid, invalid, {r('CAST(invalid AS DOUBLE) / (valid + invalid) * 100', 1)} AS error_pct,
           CASE WHEN CAST(invalid AS DOUBLE) / (valid + invalid) < 0.05 THEN 'ok' ELSE 'warn' END AS status FROM j""")
query("l18_min_rows", lambda b: h.min_rows({"tool_events": b.tool_events, "agents": b.agents}), """
    SELECT name, n AS rows, CASE WHEN n >= 1000 THEN 'ok' ELSE 'warn' END AS status FROM
    (SELECT 'tool_events' AS name, count(*) AS n FROM tool_events UNION ALL SELECT 'agents', count(*) FROM agents)""")


def snapshots(b):
    half = F.col("ts") < 1705276800
    rows = b.heal_runs.select(F.lit("all").alias("target"), "ts", "ok",
                              (F.col("ok") + F.col("warn") + F.col("error")).alias("total"))
    return h.compare_snapshots(rows.filter(half), rows.filter(~half), "target")


query("l27_compare_snapshots", snapshots, """
    WITH x AS (SELECT ts < 1705276800 AS before, CAST(sum(ok) AS DOUBLE) / CAST(sum(ok + warn + error) AS DOUBLE) AS s
               FROM heal_runs GROUP BY 1),
    y AS (SELECT max(s) FILTER (WHERE before) AS baseline, max(s) FILTER (WHERE NOT before) AS after FROM x)
    SELECT 'all' AS target, baseline, after, after - baseline AS improvement, CASE WHEN after - baseline >= 0
           THEN 'applied' ELSE 'rolled_back' END AS status FROM y""")
