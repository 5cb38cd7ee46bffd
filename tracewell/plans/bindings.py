"""Canonical telemetry tables bound to the shared star-schema Parquet tables.

Each binding is a list of column expressions in the part of SQL that Spark and
DuckDB read alike. :class:`Bindings` turns it into a lazy DataFrame, and
:func:`with_clause` prints the same mapping as a common table expression for
the oracle. Nothing is filtered here: every bound table covers its whole source.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations").split()


@dataclass(frozen=True)
class View:
    source: str
    cols: str                      # "name: expression" per line
    group: tuple[str, ...] = ()    # grouping columns, evaluated on the source
    join: tuple[str, str, str] | None = None   # (table, condition columns, how)


# Words in capitals are replaced per engine, see _SPARK and _DUCK.
_MODEL = "CASE l_returnflag WHEN 'A' THEN 'opus' WHEN 'N' THEN 'sonnet' ELSE 'haiku' END"


def _choice(col: str, **pairs: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE {col} {whens} END"


def _tier_sums(measure: str, expr: str) -> str:
    return "\n".join(
        f"{m}_{measure}: CAST(FLOOR(COALESCE(SUM(CASE WHEN {_MODEL} = '{m}' THEN {expr} END), 0) + 0.001) AS BIGINT)"
        for m in ("opus", "sonnet", "haiku"))


VIEWS: dict[str, View] = {
    "events_k": View("events", "event_id: event_id\nts: ts\nuser_id: user_id\nevent_type: event_type\n"
                               "value: value\nprops: props\nk: JSON_K\ntimestamp: EPOCH(ts)"),
    "tool_events": View("events_k", f"""
        id: event_id
        timestamp: timestamp
        tool_name: {_choice("event_type", click="Read", view="Bash", purchase="Edit", signup="Write", error="Grep")}
        success: CAST(CASE WHEN k >= 10 THEN 1 ELSE 0 END AS BIGINT)
        duration_ms: value
        error_message: CASE WHEN k < 10 THEN 'E' || CAST(k % 5 AS STRING) END
        context: '/p/' || CAST(user_id % 10 AS STRING)
        session_id: CAST(user_id AS STRING)"""),
    "activity_events": View("events_k", """
        id: event_id
        timestamp: timestamp
        event_type: event_type
        data: props
        session_id: CAST(user_id AS STRING)"""),
    "order_lines": View("lineitem", """
        lk: l_orderkey
        ended_at: MAX(EPOCH(l_shipdate))
        qty: CAST(SUM(l_quantity) AS BIGINT)
        n: COUNT(*)
        ext: FLOOR(SUM(l_extendedprice) * 1e2 + 5e-1) / 1e2
        lines: CAST(SUM(l_linenumber) AS BIGINT)""", group=("l_orderkey",)),
    "sessions": View("orders", f"""
        id: CAST(o_orderkey AS STRING)
        project_path: '/p/c' || CAST(o_custkey AS STRING)
        model: {_choice("SUBSTR(o_orderpriority, 1, 1)", **{"1": "opus", "2": "opus-next", "3": "sonnet",
                                                            "4": "sonnet", "5": "haiku"})}
        started_at: EPOCH(o_orderdate)
        ended_at: ended_at
        message_count: COALESCE(qty, 0)
        tool_count: COALESCE(n, 0)
        input_tokens: COALESCE(CAST(FLOOR(ext) AS BIGINT), 0)
        output_tokens: COALESCE(qty * 100, 0)
        cache_read_tokens: COALESCE(lines * 5000, 0)
        outcome: {_choice("o_orderstatus", F="success", O="abandoned", P="partial")}
        cost_estimate: o_totalprice""", join=("order_lines", "o_orderkey = lk", "left")),
    "session_outcome_events": View("lineitem", f"""
        id: l_orderkey * 1000000 + l_partkey * 10 + l_linenumber
        timestamp: EPOCH(l_shipdate)
        session_id: CAST(l_orderkey AS STRING)
        outcome: CASE WHEN l_linestatus = 'F' THEN 'success' WHEN l_returnflag = 'R' THEN 'error' ELSE 'partial' END
        quality_score: 1 + 40 * l_discount + l_linenumber / 1e4
        complexity: l_quantity / 50
        model_used: {_MODEL}
        cost: l_extendedprice
        message_count: CAST(l_quantity AS BIGINT)"""),
    "daily_stats": View("lineitem", f"""
        date: CAST(CAST(l_shipdate AS DATE) AS STRING)
        {_tier_sums("messages", "1")}
        {_tier_sums("tokens_in", "l_quantity * 100")}
        {_tier_sums("tokens_out", "l_extendedprice")}
        {_tier_sums("cache_read", "l_linenumber * 5000")}
        session_count: CAST(SUM(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS BIGINT)
        tool_calls: CAST(SUM(l_linenumber) AS BIGINT)
        cost_estimate: FLOOR(SUM(l_extendedprice / 1e3) * 1e5 + 5e-1) / 1e5""",
        group=("CAST(CAST(l_shipdate AS DATE) AS STRING)",)),
    "hourly_activity": View("events_k", """
        date: CAST(CAST(ts AS DATE) AS STRING)
        hour: CAST(HOUR(ts) AS BIGINT)
        session_count: COUNT(DISTINCT user_id)
        message_count: COUNT(*)""",
        group=("CAST(CAST(ts AS DATE) AS STRING)", "CAST(HOUR(ts) AS BIGINT)")),
    "routing_decisions": View("lineitem", f"""
        id: l_orderkey * 1000000 + l_partkey * 10 + l_linenumber
        timestamp: EPOCH(l_shipdate)
        query_hash: CAST(l_partkey AS STRING)
        query_preview: 'part ' || CAST(l_partkey AS STRING)
        complexity: l_quantity / 50
        selected_model: {_MODEL}
        dq_score: CASE WHEN l_discount = 0 THEN 0e0 ELSE 10 * l_discount - l_linenumber / 1e4 END
        dq_validity: CASE WHEN l_linenumber > 1 THEN 10 * l_tax END
        dq_specificity: 1 - 10 * l_discount
        dq_correctness: l_quantity / 100
        success: CAST(CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS BIGINT)"""),
    "routing_events": View("routing_decisions", """
        id: id
        timestamp: timestamp
        query_hash: query_hash
        complexity: complexity
        dq_score: dq_score
        chosen_model: selected_model"""),
    "expertise_routing_events": View("lineitem", f"""
        id: l_orderkey * 1000000 + l_partkey * 10 + l_linenumber
        timestamp: EPOCH(l_shipdate)
        domain: LOWER(p_type)
        expertise_level: 10 * l_discount
        query_complexity: l_quantity / 50
        chosen_model: {_MODEL}""", join=("part", "l_partkey = p_partkey", "inner")),
    "crm_contacts": View("customer", """
        id: c_custkey
        name: c_name
        company: 'N' || CAST(c_nationkey AS STRING)
        category: LOWER(c_mktsegment)
        updated_at: c_custkey"""),
    "crm_deals": View("orders", f"""
        id: o_orderkey
        contact_id: o_custkey
        title: 'order ' || CAST(o_orderkey AS STRING)
        stage: {_choice("o_orderstatus", F="won", O="prospect", P="meeting")}
        value: o_totalprice
        updated_at: EPOCH(o_orderdate)"""),
    "crm_interactions": View("events_k", """
        id: event_id
        contact_id: user_id
        type: event_type
        follow_up: CASE WHEN k >= 50 THEN 'call ' || CAST(k AS STRING) END
        follow_up_date: CAST(ADD_DAYS(CAST(ts AS DATE), k % 20) AS STRING)
        created_at: timestamp"""),
    "self_heal_events": View("events_k", """
        id: event_id
        timestamp: timestamp
        error_pattern: event_type
        fix_applied: CASE WHEN k % 4 > 0 THEN 'fix' || CAST(k % 4 AS STRING) END
        success: CAST(CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END AS BIGINT)
        execution_time_ms: value
        severity: CASE WHEN k >= 80 THEN 'high' ELSE 'low' END
        error_message: props"""),
    "recovery_events": View("orders", """
        id: o_orderkey
        timestamp: EPOCH(o_orderdate)
        error_type: LOWER(SUBSTR(o_orderpriority, 3))
        recovery_strategy: CASE WHEN o_custkey % 5 > 0 THEN 'strategy' || CAST(o_custkey % 5 AS STRING) END
        success: CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT)
        attempts: 1 + o_custkey % 3
        recovery_method: CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'method' || o_orderstatus END"""),
    "recovery_log": View("events_k", """
        action: event_type
        pattern: CASE WHEN k % 4 > 0 THEN 'pat' || CAST(k % 4 AS STRING) ELSE '' END
        category: 'cat' || CAST(k % 6 AS STRING)
        success: CAST(CASE WHEN k >= 45 THEN 1 ELSE 0 END AS BIGINT)
        ts: timestamp"""),
    "heal_runs": View("events_k", """
        id: event_id
        ts: timestamp
        ok: 10 + k % 7
        warn: k % 3
        error: CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END
        fixed: CASE WHEN k >= 60 THEN k % 4 ELSE 0 END"""),
    "command_events": View("events_k", f"""
        id: event_id
        timestamp: timestamp
        command: {_choice("event_type", click="co", view="CC", purchase="haiku", signup="git", error="")}
        args: props
        success: CAST(CASE WHEN k >= 10 THEN 1 ELSE 0 END AS BIGINT)
        execution_time_ms: value"""),
    "coordinator_events": View("events_k", f"""
        id: event_id
        timestamp: timestamp
        agent_id: 'a' || CAST(user_id AS STRING)
        action: {_choice("event_type", click="complete", view="fail", purchase="timeout", signup="spawn",
                         error="complete")}
        strategy: CASE WHEN k < 10 THEN '' WHEN k < 20 THEN NULL WHEN k < 50 THEN 'parallel' ELSE 'serial' END
        result: props || props || props || props || props || props || props || props || props
        duration_ms: value
        exit_code: k % 2"""),
    "git_events": View("orders", """
        id: o_orderkey
        timestamp: EPOCH(o_orderdate)
        event_type: 'commit'
        repo: 'repo' || CAST(o_custkey % 20 AS STRING)
        message: o_orderstatus
        files_changed: 1 + o_custkey % 9
        additions: CAST(FLOOR(o_totalprice) AS BIGINT)
        deletions: CAST(FLOOR(o_totalprice / 10) AS BIGINT)
        author: o_orderpriority"""),
    "file_changes": View("lineitem", """
        project: 'repo' || CAST(l_suppkey % 3 AS STRING)
        file: CASE WHEN l_linenumber = 7 THEN 'README' ELSE 'src/f' || CAST(l_partkey % 97 AS STRING) || '.' ||
              CASE l_linenumber WHEN 1 THEN 'py' WHEN 2 THEN 'ts' WHEN 3 THEN 'md' WHEN 4 THEN 'png' ELSE 'sh' END END
        """),
    "cost_tracking": View("events_k", "ts: timestamp\ncost_usd: value\nid: event_id"),
    "predictions": View("events_k", f"""
        id: event_id
        timestamp: timestamp
        predicted: {_choice("event_type", click="success", view="abandon", purchase="partial", signup="?")}
        correct: CASE WHEN k >= 40 THEN 1 ELSE 0 END"""),
    "flow_history": View("events_k", """
        id: event_id
        timestamp: timestamp
        score: k / 1e2
        state: event_type"""),
    "error_log": View("events_k", """
        id: event_id
        ts: timestamp
        type: CASE WHEN k < 40 THEN event_type WHEN k < 60 THEN '' END
        category: CASE WHEN k < 90 THEN 'cat_' || event_type END
        message: props
        severity: CASE WHEN k >= 80 THEN 'high' END"""),
    "tool_log": View("events_k", f"""
        id: event_id
        ts: timestamp
        tool: {_choice("event_type", click="Read", view="Bash", purchase="Edit", signup="Write")}
        model: CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'opus' WHEN k % 4 = 2 THEN 'sonnet' ELSE 'haiku' END
        success: CAST(CASE WHEN k >= 20 THEN 1 ELSE 0 END AS BIGINT)"""),
    "command_log": View("events_k", f"""
        cmd: CASE WHEN k % 2 = 0 THEN event_type END
        command: CASE WHEN k % 5 > 0 THEN event_type || ' run' END
        count: CASE WHEN k % 3 > 0 THEN k % 3 END"""),
    "dq_log": View("events_k", """
        ts: CASE WHEN k % 2 = 0 THEN timestamp * 1000 ELSE timestamp END
        dqScore: CASE WHEN k < 50 THEN k / 1e2 END
        dq: CASE WHEN k BETWEEN 40 AND 79 THEN k / 1e2 END
        dq_obj_score: CASE WHEN k >= 80 THEN k / 1e2 END
        query: props
        model: CASE WHEN k % 3 = 0 THEN 'opus' WHEN k % 3 = 1 THEN 'haiku' END
        complexity: CASE WHEN k % 5 > 0 THEN k / 1e2 END"""),
    "memory_items": View("documents", """
        id: doc_id
        project: CASE WHEN doc_id % 7 > 0 THEN 'project-' || lang END
        source: source
        created_at: CAST(ADD_DAYS(DATE '2024-01-31', -(doc_id % 60)) AS STRING)"""),
    "learnings": View("documents", """
        id: doc_id
        content: text
        category: lang
        project: source
        quality: 1 + doc_id % 5
        date: CAST(ADD_DAYS(DATE '2024-01-31', -(doc_id % 45)) AS STRING)"""),
    "error_patterns": View("documents", """
        category: lang
        pattern: source
        count: COUNT(*)""", group=("lang", "source")),
    "reviews": View("labels", """
        id: doc_id
        category: lang
        next_review: CAST(ADD_DAYS(DATE '2024-01-31', doc_id % 30 - 15) AS STRING)""",
        join=("documents_key", "doc_id = d_id", "inner")),
    "documents_key": View("documents", "d_id: doc_id\nlang: lang\nsource: source"),
    "knowledge": View("documents", """
        id: doc_id
        type: CASE lang WHEN 'en' THEN 'facts' WHEN 'fr' THEN 'decisions' ELSE 'patterns' END
        tag_text: source || ',' || lang || CASE WHEN n_chars > 3000 THEN ',long' ELSE '' END
        timestamp: CAST(ADD_DAYS(DATE '2024-01-31', -(doc_id % 200)) AS STRING) || 'T00:00:00'"""),
    "project_files": View("documents", """
        project: source
        ext: lang
        files: COUNT(*)
        lines: CAST(SUM(n_chars) AS BIGINT)""", group=("source", "lang")),
    "agents": View("customer", f"""
        agent_id: 'a' || CAST(c_custkey AS STRING)
        state: {_choice("c_mktsegment", AUTOMOBILE="pending", BUILDING="running", FURNITURE="done",
                        MACHINERY="failed")}
        model: CASE WHEN c_nationkey % 3 = 0 THEN 'opus' WHEN c_nationkey % 3 = 1 THEN 'haiku' END
        cost_estimate: c_acctbal"""),
    "locks": View("orders", """
        path: 'file' || CAST(o_custkey AS STRING)
        agent_id: 'a' || CAST(o_orderkey % 211 AS STRING)
        lock_type: CASE WHEN o_orderstatus = 'F' THEN 'write' ELSE 'read' END"""),
    "packs": View("part", "id: p_partkey\ntype: LOWER(p_type)\nsize: p_size"),
    "pattern_log": View("events_k", f"""
        date: CAST(CAST(ts AS DATE) AS STRING)
        pattern: {_choice("event_type", click="implementation", view="research", purchase="testing",
                          signup="review", error="debugging")}"""),
    "turns": View("conversations", """
        session_id: 's' || CAST(conv_id AS STRING)
        turn: turn
        timestamp: 1704067200 + conv_id * 4000 + turn * 130
        type: role
        text: text
        model: CASE WHEN role = 'assistant' THEN CASE WHEN (conv_id + turn) % 7 = 0 THEN 'x-opus-1'
               WHEN (conv_id + turn) % 3 = 0 THEN 'x-haiku-2' ELSE 'x-sonnet-3' END END
        tools: CASE WHEN role = 'assistant' THEN LENGTH(text) % 9 ELSE 0 END
        stop_reason: CASE WHEN role = 'assistant' AND (conv_id * 5 + turn) % 41 = 0 THEN 'error' ELSE 'end' END
        input_tokens: CASE WHEN role = 'assistant' AND turn > 1 THEN LENGTH(text) END
        output_tokens: LENGTH(text) * 2
        cache_read_tokens: LENGTH(text) * 7
        cache_create_tokens: LENGTH(text)"""),
    "log_lines": View("events_k", """
        id: event_id
        line: CASE WHEN event_type = 'error' THEN 'plain noise ' || CAST(k AS STRING) ELSE
              '[' || SUBSTR(CAST(ts AS STRING), 1, 19) || ' EST] ' ||
              CASE event_type WHEN 'click' THEN 'LOADED svc.worker' || CAST(k % 5 AS STRING)
              WHEN 'view' THEN 'DOWN: svc.worker' || CAST(k % 5 AS STRING)
              WHEN 'purchase' THEN 'HEALED ' || CAST(k AS STRING) || ' daemons'
              ELSE 'SESSION ' || SUBSTR(CAST(ts AS STRING), 1, 10) END END"""),
    "json_lines": View("events_k", """
        id: event_id
        line: CASE WHEN event_type = 'error' THEN SUBSTR(props, 1, LENGTH(props) - 1)
              WHEN event_type = 'signup' THEN ' ' ELSE props END"""),
    "autonomy_events": View("events_k", f"""
        id: event_id
        timestamp: timestamp
        event_type: {_choice("event_type", click="permission_prompt", view="permission_granted",
                             purchase="permission_denied", signup="permission_prompt", error="other")}"""),
    "sync_events": View("events_k", """
        ts: timestamp
        tool: CASE event_type WHEN 'click' THEN 'session_start' WHEN 'view' THEN 'Bash' WHEN 'purchase' THEN 'Bash'
              WHEN 'signup' THEN 'Edit' ELSE 'Read' END
        file_path: CASE WHEN k % 2 = 0 THEN '/src/f' || CAST(k AS STRING) END
        session_pwd: CASE WHEN k % 9 > 0 THEN '/home/work/project' || CAST(user_id AS STRING) END
        metadata: CASE WHEN k < 5 THEN NULL WHEN k < 10 THEN 'oops' WHEN k < 60 THEN
                  '{"command": "git  log ' || CAST(k AS STRING) || '", "success": ' ||
                  CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ', "model": "opus"}'
                  ELSE '{"command": "", "exit_code": 2}' END
        id: event_id"""),
}


def _spark(expr: str) -> str:
    expr = re.sub(r"EPOCH\(", "unix_timestamp(", expr)
    expr = expr.replace("JSON_K", "CAST(get_json_object(props, '$.k') AS BIGINT)")
    return re.sub(r"ADD_DAYS\((.*?), (-?\(?\w+ % \d+\)?(?: - \d+)?)\)", r"date_add(\1, CAST(\2 AS INT))", expr)


def _duck(expr: str) -> str:
    expr = re.sub(r"EPOCH\((\w+)\)", r"(epoch_us(\1) // 1000000)", expr)
    expr = expr.replace("JSON_K", "CAST(json_extract_string(props, '$.k') AS BIGINT)")
    return re.sub(r"ADD_DAYS\((.*?), (-?\(?\w+ % \d+\)?(?: - \d+)?)\)", r"(\1 + CAST(\2 AS INTEGER))", expr)


def _columns(view: View) -> list[tuple[str, str]]:
    out: list[list[str]] = []
    for line in view.cols.strip().splitlines():
        m = re.match(r"\s*(\w+): (.*)", line)
        if m:
            out.append([m[1], m[2]])
        else:
            out[-1][1] += " " + line.strip()
    return [(n, e) for n, e in out]



#: Event-time column of the base tables that have one.
TIME_COLUMNS = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read_base(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A base table; its schema is read from a file footer once per process."""
    path = f"{root}/{name}.parquet"
    schema = _SCHEMAS.get((root, name))
    df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    _SCHEMAS[root, name] = df.schema
    return df


class Bindings:
    """Lazy DataFrames for every base and canonical table under ``root``.

    ``after`` (epoch seconds) keeps only base rows at or after that instant. It is
    a plain comparison on the stored time column, so it reaches the Parquet scan
    and prunes row groups, which a filter on the derived epoch cannot do.
    """

    def __init__(self, spark: SparkSession, root: str, after: int | None = None):
        self.spark, self.root, self._after = spark, root, after
        self._cache: dict[str, DataFrame] = {}

    def since(self, after: int) -> Bindings:
        """The same tables, their time columns bounded below."""
        return Bindings(self.spark, self.root, after)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in BASE_TABLES):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._build(name)
        return self._cache[name]

    def _base(self, name: str) -> DataFrame:
        df = read_base(self.spark, self.root, name)
        if self._after is None or name not in TIME_COLUMNS:
            return df
        bound = datetime.fromtimestamp(self._after, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        return df.filter(F.col(TIME_COLUMNS[name]) >= F.expr(f"TIMESTAMP_NTZ '{bound}'"))

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self._base(name)
        view = VIEWS[name]
        df = getattr(self, view.source)
        if view.join:
            other, cond, how = view.join
            left, right = cond.split(" = ")
            df = df.join(getattr(self, other), F.col(left) == F.col(right), how)
        if not view.group:
            return df.selectExpr(*[f"{_spark(e)} AS {n}" for n, e in _columns(view)])
        keys = [F.expr(_spark(g)).alias(f"_g{i}") for i, g in enumerate(view.group)]
        grouped = {g: f"_g{i}" for i, g in enumerate(view.group)}
        aggs = [F.expr(_spark(e)).alias(n) for n, e in _columns(view) if e not in grouped]
        out = df.groupBy(*keys).agg(*aggs)
        return out.select(*[F.col(grouped[e]).alias(n) if e in grouped else F.col(n) for n, e in _columns(view)])

    @cached_property
    def daily_long(self) -> DataFrame:
        from tracewell.operators.daily import to_long
        return to_long(self.daily_stats)


def _cte(name: str) -> str:
    view = VIEWS[name]
    cols = ", ".join(f"{_duck(e)} AS {n}" for n, e in _columns(view))
    frm = view.source
    if view.join:
        other, cond, how = view.join
        frm += f" {how} JOIN {other} ON {cond}"
    tail = f" GROUP BY {', '.join(_duck(g) for g in view.group)}" if view.group else ""
    return f"{name} AS (SELECT {cols} FROM {frm}{tail})"


def with_clause(body: str) -> str:
    """``body`` prefixed by the bound views it mentions, in dependency order."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed or name not in VIEWS:
            return
        view = VIEWS[name]
        visit(view.source)
        if view.join:
            visit(view.join[0])
        needed.append(name)

    for word in re.findall(r"\w+", body):
        visit(word)
    if not needed:
        return body
    ctes = ",\n".join(_cte(n) for n in needed)
    body = body.strip()
    if body[:5].lower() == "with ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
