"""Struct types of the canonical telemetry tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Table and column names and types. ``timestamp`` columns are epoch seconds, dates are text.
DDL: dict[str, str] = {
    "sessions":
        "id string, project_path string, model string, started_at bigint, ended_at bigint, "
        "message_count bigint, tool_count bigint, input_tokens bigint, output_tokens bigint, "
        "cache_read_tokens bigint, outcome string, quality_score double, dq_score double, "
        "complexity double, cost_estimate double, metadata string",
    "daily_stats":
        "date string, opus_messages bigint, opus_tokens_in bigint, opus_tokens_out bigint, "
        "opus_cache_read bigint, sonnet_messages bigint, sonnet_tokens_in bigint, "
        "sonnet_tokens_out bigint, sonnet_cache_read bigint, haiku_messages bigint, "
        "haiku_tokens_in bigint, haiku_tokens_out bigint, haiku_cache_read bigint, session_count bigint, "
        "tool_calls bigint, cost_estimate double",
    "routing_decisions":
        "id bigint, timestamp bigint, query_hash string, query_preview string, complexity double, "
        "selected_model string, dq_score double, dq_validity double, dq_specificity double, "
        "dq_correctness double, cost_estimate double, success bigint, feedback_at bigint",
    "tool_usage":
        "tool_name string, total_calls bigint, success_count bigint, failure_count bigint, "
        "last_used bigint, avg_duration_ms double",
    "hourly_activity":
        "date string, hour bigint, session_count bigint, message_count bigint",
    "projects":
        "id string, name string, path string, last_active bigint, session_count bigint, "
        "total_messages bigint, total_cost double, status string",
    "subscription_periods":
        "id bigint, start_date string, end_date string, rate double, total_value double, "
        "total_messages bigint, roi double",
    "metadata":
        "key string, value string, updated_at bigint",
    "tool_events":
        "id bigint, timestamp bigint, tool_name string, success bigint, duration_ms double, "
        "error_message string, context string, session_id string",
    "activity_events":
        "id bigint, timestamp bigint, event_type string, data string, session_id string",
    "routing_events":
        "id bigint, timestamp bigint, query_hash string, complexity double, dq_score double, "
        "chosen_model string, reasoning string, feedback string",
    "session_outcome_events":
        "id bigint, timestamp bigint, session_id string, outcome string, quality_score double, "
        "complexity double, model_used string, cost double, message_count bigint",
    "command_events":
        "id bigint, timestamp bigint, command string, args string, success bigint, "
        "execution_time_ms double",
    "routing_metrics_events":
        "id bigint, timestamp bigint, query_id string, predicted_model string, actual_model string, "
        "dq_score double, complexity double, accuracy bigint, cost_saved double, reasoning string, "
        "query_text string",
    "git_events":
        "id bigint, timestamp bigint, event_type string, repo string, branch string, commit_hash string, "
        "message string, files_changed bigint, additions bigint, deletions bigint, author string",
    "self_heal_events":
        "id bigint, timestamp bigint, error_pattern string, fix_applied string, success bigint, "
        "execution_time_ms double, error_message string, context string, severity string",
    "recovery_events":
        "id bigint, timestamp bigint, error_type string, recovery_strategy string, success bigint, "
        "attempts bigint, time_to_recover_ms double, error_details string, recovery_method string",
    "coordinator_events":
        "id bigint, timestamp bigint, agent_id string, action string, strategy string, file_path string, "
        "result string, duration_ms double, exit_code bigint",
    "expertise_routing_events":
        "id bigint, timestamp bigint, domain string, expertise_level double, query_complexity double, "
        "chosen_model string, reasoning string, query_hash string",
    "autonomy_events":
        "id bigint, timestamp bigint, event_type string, session_id string, tool_name string, "
        "context string",
    "autonomy_streaks":
        "start_ts bigint, end_ts bigint, duration_seconds bigint, tool_count bigint, "
        "avg_gap_seconds double, projects array<string>, top_tools map<string,bigint>, "
        "session_ids array<string>",
    "crm_contacts":
        "id string, name string, company string, role string, email string, phone string, "
        "x_handle string, linkedin string, category string, tags string, notes string, source string, "
        "created_at bigint, updated_at bigint",
    "crm_deals":
        "id string, contact_id string, title string, stage string, value double, currency string, "
        "product string, notes string, next_action string, next_action_date string, created_at bigint, "
        "updated_at bigint",
    "crm_interactions":
        "id string, contact_id string, deal_id string, type string, summary string, sentiment string, "
        "follow_up string, follow_up_date string, created_at bigint",
    "memory_items":
        "id bigint, project string, source string, created_at string",
    "learnings":
        "id string, content string, category string, project string, quality double, date string",
    "error_patterns":
        "category string, pattern string, count bigint, solution string",
    "reviews":
        "id string, content string, category string, next_review string",
}

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType()),
          "map<string,bigint>": T.MapType(T.StringType(), T.LongType())}


def _struct(ddl: str) -> T.StructType:
    """``StructType.fromDDL`` needs a session, and schemas are wanted before there is one."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


#: table name -> StructType
SCHEMAS: dict[str, T.StructType] = {name: _struct(ddl) for name, ddl in DDL.items()}
