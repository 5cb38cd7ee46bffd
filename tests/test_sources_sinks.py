"""Readers and writers on real files."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rows import frame
from tracewell.operators import coordination, health, recovery, transcripts
from tracewell.schemas import SCHEMAS
from tracewell.sinks import panels, upserts
from tracewell.sinks.batches import BatchTable
from tracewell.sources import incremental, jsonl, logs, tables
from tracewell.store import COUNTERS
from tracewell.sources.transcripts import explode_tool_use, read_transcripts


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_jsonl_is_tolerant(spark, tmp_path):
    p = put(f"{tmp_path}/a.jsonl", '{"a":1}\n\nnot json\n{"b":2}\nbad line\n[1, 2]\n')
    assert sorted((r.a or 0, r.b or 0) for r in jsonl.read_jsonl(spark, p, "a long, b long").collect()) == [
        (0, 0), (0, 2), (1, 0)]
    kept = jsonl.read_jsonl(spark, p, "a long", keep_bad=True)
    assert kept.filter("_bad").count() == 2
    assert jsonl.read_jsonl(spark, f"{tmp_path}/none.jsonl", "a long").count() == 0


@pytest.mark.parametrize("text,valid,invalid,status", [
    ('{"a":1}\n{"b":2}', 2, 0, "ok"), ('{"ok":1}\nnot json\nbad line', 1, 2, "warn"), ("\n", 0, 0, "ok")])
def test_jsonl_health(spark, tmp_path, text, valid, invalid, status):
    p = put(f"{tmp_path}/h.jsonl", text)
    r = health.jsonl_health(jsonl.read_lines(spark, p), jsonl.RAW).first()
    assert (r.valid, r.invalid, r.status) == (valid, invalid, status)


def test_quarantine(spark, tmp_path):
    p = put(f"{tmp_path}/q.jsonl", '{"a":1}\noops\n{"a":2}\n')
    counts = panels.quarantine(jsonl.read_lines(spark, p), f"{tmp_path}/good", f"{tmp_path}/bad").first()
    assert (counts.kept, counts.removed) == (2, 1)
    assert spark.read.text(f"{tmp_path}/good").count() == 2 and spark.read.text(f"{tmp_path}/bad").first()[0] == "oops"


def test_document_and_registries(spark, tmp_path):
    agents = {"a1": {"state": "running", "model": "opus", "cost_estimate": 2.5}, "a2": {"state": "done"}}
    locks = {"/x": [{"agent_id": "a1", "lock_type": "read"}, {"agent_id": "a2", "lock_type": "write"}], "/y": []}
    p = put(f"{tmp_path}/s.json", json.dumps({"agents": agents, "locks": locks}, indent=1))
    doc = jsonl.read_document(
        spark, p, "agents map<string,struct<state:string,model:string,cost_estimate:double>>, "
                  "locks map<string,array<struct<agent_id:string,lock_type:string>>>")
    reg = coordination.explode_registry(doc, "agents", "agent_id")
    assert coordination.agent_totals(reg).first().asDict() == {"total_agents": 2, "active": 1, "total_cost": 2.5}
    t = coordination.lock_totals(coordination.explode_locks(doc, "locks")).first().asDict()
    assert t == {"total_locks": 2, "read_locks": 1, "write_locks": 1, "files_locked": 2, "agents_with_locks": 2}
    assert jsonl.read_document(spark, f"{tmp_path}/missing.json", "a int").count() == 0


def test_table_default_and_bootstrap(spark, tmp_path):
    assert tables.read_table(spark, None, SCHEMAS["sessions"]).count() == 0
    assert tables.read_table(spark, f"{tmp_path}/none", SCHEMAS["sessions"]).count() == 0
    made = tables.bootstrap(spark, f"{tmp_path}/store")
    assert sorted(made) == sorted(SCHEMAS)
    assert tables.bootstrap(spark, f"{tmp_path}/store") == []
    assert tables.read_store(spark, f"{tmp_path}/store", ["git_events"])["git_events"].schema == SCHEMAS["git_events"]


def test_views(spark, store):
    tables.register_views({n: store[n] for n in ("daily_stats", "sessions", "routing_decisions")}, as_of="2026-02-13")
    assert spark.table("v_subscription_summary").first().total_messages == 361
    assert spark.sql("select opus_pct from v_model_distribution").first()[0] == 78.9
    assert spark.sql("select count(*) from v_recent_sessions").first()[0] == 3


def turn(ts, kind, message):
    return json.dumps({"timestamp": ts, "type": kind, "message": message})


def test_transcripts(spark, tmp_path):
    asst = {"model": "m-opus-4", "stopReason": "end", "usage": {"input_tokens": 5, "output_tokens": 7,
                                                                 "cache_read_input_tokens": 11},
            "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Bash"}, {"type": "tool_use"}]}
    lines = [turn("2026-01-19T14:30:00", "user", {"content": "ok"}),
             turn("2026-01-19T14:31:00", "user", {"content": [{"type": "text", "text": "please"}, "help me"]}),
             "this is not json", turn("2026-01-19T15:00:00", "assistant", asst),
             turn("2026-01-19T15:00:01", "assistant", {"model": "m-haiku", "content": "plain"}),
             turn("2026-01-19T15:00:02", "user", "bare text")]
    put(f"{tmp_path}/proj/deep/one.jsonl", "\n".join(lines))
    bad = turn("2026-01-20T01:00:00", "assistant", {"model": "m-sonnet", "stopReason": "error", "content": []})
    put(f"{tmp_path}/two.jsonl", bad + "\n")
    turns = read_transcripts(spark, str(tmp_path))
    assert turns.count() == 6
    texts = {r.text for r in turns.collect()}
    assert {"ok", "please help me", "plain", "bare text"} <= texts
    assert sorted(r.tool_name for r in explode_tool_use(turns).collect()) == ["Bash", "unknown"]
    s = {r.session_id: r for r in transcripts.score_sessions(transcripts.fold_sessions(turns)).collect()}
    one, two = s["one"], s["two"]
    assert (one.messages, one.tools, one.hours, one.opus, one.haiku) == (5, 2, [14, 15], 1, 1)
    assert one.title == "please help me" and one.outcome == "partial" and one.date == "2026-01-19"
    assert two.outcome == "error" and two.primary_model == "sonnet" and two.title is None
    u = transcripts.usage_totals(turns).first()
    assert (u.input, u.output, u.cache_read, u.cache_create) == (5, 7, 11, 0)


def test_log_parse(spark):
    df = spark.createDataFrame([
        ("[2026-01-23 14:30:06 EST] LOADED svc.boot",), ("[2026-01-23 14:31:06 EST] DOWN: svc.x",),
        ("[2026-01-23 14:32:06 EST] HEALED 3 daemons",), ("noise LOADED",)], "line string")
    got = [tuple(r) for r in logs.parse_log(df, logs.WATCHDOG_PATTERNS).select("action", "subject", "message").collect()]
    assert got == [("reload", "svc.boot", "Reloaded svc.boot"), ("detected", "svc.x", "Detected svc.x down"),
                   ("heal", "watchdog", "Healed 3 daemon(s)")]


def test_effectiveness(spark):
    rows = [("clear_locks", 1), ("clear_locks", 1), ("reload", 0)]
    got = {r.action: (r.rate, r.band) for r in recovery.effectiveness(
        spark.createDataFrame(rows, "action string, success int")).collect()}
    assert got == {"clear_locks": (100.0, "good"), "reload": (0.0, "poor")}


def test_increment(spark):
    old = spark.createDataFrame([(1, 10), (2, 20)], "id int, ts long")
    new = spark.createDataFrame([(2, 20), (3, 20), (4, 30)], "id int, ts long")
    assert [r.id for r in incremental.new_rows(new, old, "ts").collect()] == [4]
    assert sorted(r.id for r in incremental.missing_rows(new, old, "id").collect()) == [3, 4]
    assert incremental.new_rows(new, old.limit(0), "ts").count() == 3


def calls(spark, name, n, ok, at):
    return spark.createDataFrame([(name, n, ok, at)], "tool_name string, calls long, success int, timestamp long")


def usage_table(spark, root, **more):
    return BatchTable(spark, f"{root}/usage", SCHEMAS["tool_usage"], ["tool_name"], **COUNTERS["tool_usage"], **more)


def test_counter_batches(spark, tmp_path):
    table = usage_table(spark, tmp_path)
    for k, n, ok in ((1, 3, 1), (2, 2, 0), (2, 2, 0)):      # the last is a replay
        table.write(upserts.tool_usage_delta(calls(spark, "Read", n, ok, 5)), "b", k)
    r = table.read().first()
    assert (r.total_calls, r.success_count, r.failure_count, r.avg_duration_ms) == (5, 3, 2, None)
    assert table.read(below=2).first().total_calls == 3
    table.write(spark.createDataFrame([("Read", 1.5)], "tool_name string, avg_duration_ms double"), "b", 3)
    table.write(upserts.tool_usage_delta(calls(spark, "Read", 1, 1, 4)), "b", 4)
    r = table.read().first()
    assert (r.total_calls, r.last_used, r.avg_duration_ms) == (6, 5, 1.5)     # what a batch lacks stays


def test_a_batch_writes_its_own_keys_only(spark, tmp_path):
    table = BatchTable(spark, f"{tmp_path}/t", StructType.fromDDL("k long, v string"), ["k"], span=10)
    table.write(spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("v")), "q", 0)
    table.write(spark.createDataFrame([(7, "b")], "k long, v string"), "q", 1)
    assert spark.read.parquet(f"{tmp_path}/t/batches/_span=0/_number=1").count() == 1
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert table.read().count() == 500 and table.read().filter("k = 7").first().v == "b"


def test_fold_and_retire(spark, tmp_path):
    table = BatchTable(spark, f"{tmp_path}/t", StructType.fromDDL("k string, v long"), ["k"], span=2)
    row = lambda k, v: spark.createDataFrame([(k, v)], "k string, v long")
    for n in range(5):
        table.write(row("x" if n % 2 else None, n), "q", n)
    rows = lambda: sorted(((r.k, r.v) for r in table.read().collect()), key=repr)
    assert rows() == [("x", 3), (None, 4)]        # a null is a key
    assert table.fold(4) == 4 and rows() == [("x", 3), (None, 4)] and table.fold(2) == 4
    assert table.write(row("x", 99), "q", 1) == 1 and rows() == [("x", 3), (None, 4)]     # folded long ago
    assert table.retire() == [0, 1] and rows() == [("x", 3), (None, 4)] and table.retire() == []
    assert table.fold(5) == 5 and table.retire() == [] and rows() == [("x", 3), (None, 4)]
    table.write(row("y", 6), "q", 6)
    assert rows() == [("x", 3), ("y", 6), (None, 4)]
    table.replace_all(row("z", 1), 8)
    assert rows() == [("z", 1)]


def test_sources_of_one_table(spark, tmp_path):
    table = BatchTable(spark, f"{tmp_path}/t", StructType.fromDDL("k string, v string"), ["k"])
    row = lambda v: spark.createDataFrame([("x", v)], "k string, v string")
    table.write(row("a"), "one", 1)
    table.write(row("b"), "two", 1)
    first = table.read().collect()
    assert len(first) == 1 and table.read().collect() == first       # equal numbers: one source wins
    table.write(row("c"), "one", 2)
    assert table.read().first().v == "c"
    assert table.write(row("d")) > 2 and table.read().first().v == "d"
    with pytest.raises(ValueError):
        table.write(row("e"), "no/path", 3)


def test_replace_and_max(spark):
    old = frame(spark, "sessions", [{"id": "s1", "model": "opus", "message_count": 3}, {"id": "s2", "message_count": 1}])
    new = spark.createDataFrame([("s1", 9, 1), ("s1", 10, 2), ("s3", 4, 1)], "id string, message_count long, seq int")
    got = {r.id: (r.model, r.message_count) for r in upserts.upsert_replace(old, new, ["id"], ["seq"]).collect()}
    assert got == {"s1": (None, 10), "s2": (None, 1), "s3": (None, 4)}
    again = upserts.upsert_replace(upserts.upsert_replace(old, new, ["id"], ["seq"]), new, ["id"], ["seq"])
    assert again.count() == 3
    a = spark.createDataFrame([("d", 1, 5)], "date string, hour int, n long")
    b = spark.createDataFrame([("d", 1, 3), ("d", 2, 7)], "date string, hour int, n long")
    assert sorted(tuple(r) for r in upserts.upsert_max(a, b, ["date", "hour"], ["n"]).collect()) == [
        ("d", 1, 5), ("d", 2, 7)]


def test_feedback_rates_the_newest_open_row(spark):
    d = frame(spark, "routing_decisions", [
        {"id": 1, "timestamp": 1, "query_hash": "h"}, {"id": 2, "timestamp": 2, "query_hash": "h"},
        {"id": 3, "timestamp": 3, "query_hash": "h", "success": 0}, {"id": 4, "timestamp": 9, "query_hash": "g"}])
    fb = spark.createDataFrame([("h", 1)], "query_hash string, verdict long")
    got = {r.id: r.success for r in upserts.rate_latest(d, fb).collect()}
    assert got == {1: None, 2: 1, 3: 0, 4: None}


def test_panels_and_changes(spark, store, tmp_path):
    p = {"usage": store["tool_usage"], "hours": store["hourly_activity"]}
    assert panels.export_panels(p, str(tmp_path), ["usage"]) == ["usage"]
    assert spark.read.json(f"{tmp_path}/usage").count() == 4
    with pytest.raises(ValueError):
        panels.export_panels(p, str(tmp_path), ["nope"])
    last = panels.with_hash(store["tool_usage"], "tool_name")
    now = store["tool_usage"].withColumn("total_calls", F.when(F.col("tool_name") == "Edit", 1).otherwise(
        F.col("total_calls")))
    assert [r.tool_name for r in panels.changed_rows(now, last, "tool_name").collect()] == ["Edit"]
    panels.append_jsonl(store["hourly_activity"], f"{tmp_path}/log")
    panels.append_jsonl(store["hourly_activity"], f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 6


def test_ambiguous_batches_are_refused(spark):
    old = spark.createDataFrame([(1, "a", 0)], "id long, v string, n long")
    twice = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (1, "z", 3), (1, "z", 3)], "id long, v string, seq long")
    got = upserts.upsert_replace(old, twice, ["id"], ["seq"]).collect()
    assert sorted((r.id, r.v, r.n) for r in got) == [(1, "z", None), (2, "y", None)]
    with pytest.raises(Exception, match="no order between them"):
        upserts.upsert_replace(old, twice, ["id"]).collect()
    d = spark.createDataFrame([(1, 5, "h", None)], "id long, timestamp long, query_hash string, success long")
    with pytest.raises(Exception, match="several verdicts"):
        upserts.rate_latest(d, spark.createDataFrame([("h", 1), ("h", 0)], "query_hash string, verdict long")).collect()
