"""Raw documents, files written and read back, and streams over the given tables.

Files and stream checkpoints go to a folder of their own below ``spark.checkpoint.dir``;
only a session without that setting uses a folder of this machine.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators import coordination as co
from tracewell.operators import text_index, vector_index
from tracewell.plans.bindings import Bindings
from tracewell.operators import streaks as st
from tracewell.plans.registry import EVENTS_DAY, EVENTS_NOW, cif, dsum, query, r
from tracewell.sinks import panels as pn
from tracewell.sinks.batches import STREAM_SPAN, BatchTable
from tracewell.schemas import SCHEMAS
from tracewell.session import shared_folder
from tracewell.sources import jsonl, tables
from tracewell.sources.transcripts import explode_tool_use, parse_turns
from tracewell.store import COUNTERS, TelemetryStore
from tracewell.streaming import expiry, live
from tracewell.streaming.joins import stream_interval_join
from tracewell.streaming.run_log import RunLog, observed, read_log


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/telemetry-{uuid.uuid4().hex}"


# ---- transcripts -------------------------------------------------------------

def transcript_lines(b: Bindings) -> DataFrame:
    """Raw lines with string, object, item-list and string-list content, and lines that do not parse."""
    at = (F.lit(1700000000) + F.col("conv_id") * 1000 + F.col("turn") * 10).alias("at")
    c = b.conversations.select("conv_id", "turn", "role", "text", at)
    stamp = F.when(F.col("turn") % 2 == 0, F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.col("at").cast("string"))
    head = [stamp.alias("timestamp"), F.col("role").alias("type")]
    said, model = F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.lit("opus-4").alias("model")
    used = lambda name: F.struct(F.lit("tool_use").alias("type"), name.alias("name"))
    items = F.array(F.to_json(said), F.to_json(used(F.lit("Edit"))), F.to_json(used(F.lit(None).cast("string"))))
    usage = F.struct(F.length("text").alias("input_tokens"), F.lit(7).alias("cache_read_input_tokens"))
    listed = F.concat(F.lit('{"model":"opus-4","stopReason":"end","content":['), F.array_join(items, ","), F.lit('],"usage":'),
                      F.to_json(usage), F.lit("}"))
    message = (F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(*head, F.col("text").alias("message"))))
               .when(F.col("turn") % 4 == 1, F.to_json(F.struct(*head, F.struct(model, F.col("text").alias("content")).alias("message"))))
               .when(F.col("turn") % 4 == 2, F.concat(F.regexp_replace(F.to_json(F.struct(*head)), r"\}$", ""), F.lit(',"message":'), listed, F.lit("}")))
               .otherwise(F.to_json(F.struct(*head, F.struct(F.array("text", F.lit("end")).alias("content")).alias("message")))))
    file = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias(jsonl.FILE)
    return c.select(message.alias(jsonl.RAW), file).unionByName(
        c.filter("turn = 0").select(F.concat(F.lit("{broken "), "text").alias(jsonl.RAW), file))


TURNS = """SELECT 'conv-' || conv_id AS session_id, 1700000000 + conv_id * 1000 + turn * 10 AS timestamp, role AS type,
    CASE turn % 4 WHEN 2 THEN text || '  ' WHEN 3 THEN text || ' end' ELSE text END AS text,
    CASE WHEN turn % 4 IN (1, 2) THEN 'opus-4' END AS model,
    CASE WHEN turn % 4 = 2 AND role = 'assistant' THEN 'Edit,unknown' ELSE '' END AS tools,
    CASE WHEN turn % 4 = 2 THEN 'end' END AS stop_reason, CASE WHEN turn % 4 = 2 THEN CAST(length(text) AS BIGINT) END AS input_tokens,
    CASE WHEN turn % 4 = 2 THEN CAST(7 AS BIGINT) END AS cache_read_tokens FROM conversations"""
query("a02_a03_a04_transcript_turns", lambda b: parse_turns(transcript_lines(b)).select(
    "session_id", "timestamp", "type", "text", "model", F.array_join("tool_names", ",").alias("tools"), "stop_reason",
    "input_tokens", "cache_read_tokens"), TURNS)
query("a03_transcript_tools", lambda b: explode_tool_use(parse_turns(transcript_lines(b))).groupBy("session_id", "tool_name").agg(
    F.count(F.lit(1)).alias("n")), f"""
    WITH tt AS ({TURNS}) SELECT session_id, tool_name, count(*) AS n FROM
    (SELECT session_id, unnest(string_split(tools, ',')) AS tool_name FROM tt WHERE tools <> '') GROUP BY 1, 2""")


# ---- registry documents --------------------------------------------------------

def agent_documents(b: Bindings) -> DataFrame:
    """JSON documents {id: entry} of at most a hundred agents each, parsed."""
    entry = "struct<state:string,model:string,cost_estimate:double>"
    block = F.floor(F.substring("agent_id", 2, 20).cast("bigint") / 100)
    pairs = F.map_from_entries(F.collect_list(F.struct("agent_id", F.struct("state", "model", "cost_estimate"))))
    texts = b.agents.groupBy(block).agg(F.to_json(pairs).alias("value"))
    return texts.select(F.from_json("value", f"map<string,{entry}>").alias("doc"))


def lock_documents(b: Bindings) -> DataFrame:
    """JSON documents {path: [lock, ..]}, one for each path."""
    lock = F.collect_list(F.struct("agent_id", "lock_type"))
    texts = b.locks.groupBy("path").agg(lock.alias("l")).select(F.to_json(F.create_map("path", "l")).alias("value"))
    return texts.select(F.from_json("value", "map<string,array<struct<agent_id:string,lock_type:string>>>").alias("doc"))


query("e61_agent_documents", lambda b: co.agent_totals(co.explode_registry(agent_documents(b), "doc", "agent_id")), f"""
    SELECT count(*) AS total_agents, {cif("state IN ('pending', 'running')")} AS active,
           {dsum('cost_estimate')} AS total_cost FROM agents""")
query("e62_lock_documents", lambda b: co.lock_totals(co.explode_locks(lock_documents(b), "doc")), f"""
    SELECT count(*) AS total_locks, {cif("lock_type = 'read'")} AS read_locks,
           count(*) - {cif("lock_type = 'read'")} AS write_locks, count(DISTINCT path) AS files_locked,
           count(DISTINCT agent_id) AS agents_with_locks FROM locks""")


# ---- files written and read back -----------------------------------------------

def per_type(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


PER_TYPE = "SELECT event_type, count(*) AS n FROM activity_events GROUP BY 1"


def documents(b: Bindings) -> DataFrame:
    """A summary document per event type, read whole; what is not JSON is left out."""
    path = f"{folder(b.spark)}/docs"
    rows = per_type(b.activity_events).select(F.to_json(F.struct("event_type", "n")).alias("value"))
    rows.write.option("maxRecordsPerFile", 1).text(path)
    return jsonl.read_document(b.spark, f"{path}/part-*", "event_type string, n bigint").unionByName(
        jsonl.read_document(b.spark, f"{path}-none", "event_type string, n bigint"))


def appended_lines(b: Bindings) -> DataFrame:
    path, rows = f"{folder(b.spark)}/log", b.activity_events.select("id", "event_type")
    for side in (0, 1):
        pn.append_jsonl(rows.filter(F.col("id") % 2 == side), path)
    return per_type(jsonl.read_jsonl(b.spark, path, "id bigint, event_type string"))


def overwritten_summary(b: Bindings) -> DataFrame:
    path = f"{folder(b.spark)}/summary"
    pn.write_panel(per_type(b.activity_events.filter("id % 2 = 0")), path)
    pn.write_panel(per_type(b.activity_events), path)
    return jsonl.read_jsonl(b.spark, path, "event_type string, n bigint")


def appended_rows(b: Bindings) -> DataFrame:
    path, rows = f"{folder(b.spark)}/rows", b.activity_events.select("id", "event_type")
    for side in (0, 1):
        pn.append_rows(rows.filter(F.col("id") % 2 == side), path, partition_by="event_type")
    return per_type(b.spark.read.parquet(path))


def partial_store(b: Bindings) -> DataFrame:
    """A store with one table: the others are empty before and after they are created."""
    root = folder(b.spark)
    b.sessions.select("id").write.parquet(f"{root}/sessions")
    before = tables.read_store(b.spark, root, ["sessions", "tool_events"])
    tables.bootstrap(b.spark, root)
    after = tables.read_store(b.spark, root, ["sessions", "tool_events"])
    rows = [(w, n, df) for w, found in (("before", before), ("after", after)) for n, df in found.items()]
    out = None
    for when, name, df in rows:
        one = df.agg(F.count("id").alias("n")).select(F.lit(when).alias("stage"), F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


query("a05_documents", documents, PER_TYPE)
query("b02_append_lines", appended_lines, PER_TYPE)
query("b03_overwrite_summary", overwritten_summary, PER_TYPE)
query("b04_append_rows", appended_rows, PER_TYPE)
query("a13_a14_partial_store", partial_store, """
    SELECT stage, name, CASE name WHEN 'sessions' THEN (SELECT count(*) FROM sessions) ELSE 0 END AS n
    FROM (VALUES ('before'), ('after')) v(stage), (VALUES ('sessions'), ('tool_events')) t(name)""")


# ---- streams -------------------------------------------------------------------

class Streams(Bindings):
    """The same views over a stream of the event files."""

    def _base(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}.parquet"
        # A pattern, since a stream takes a single file only by one.
        return live.read_stream(self.spark, f"{self.root}/[{name[0]}]{name[1:]}.parquet", self.spark.read.parquet(path).schema)


def drained(b: Bindings, shape, mode: str, runs: int = 1) -> DataFrame:
    """Run a stream over all files there are, ``runs`` times from one checkpoint, and read what it wrote."""
    root = folder(b.spark)
    for _ in range(runs):
        out = shape(Streams(b.spark, b.root))
        if mode == "append":
            w = out.writeStream.format("parquet").option("path", f"{root}/out")
        else:
            w = out.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{root}/out"))
        w.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return b.spark.read.schema(out.schema).parquet(f"{root}/out")


query("j05_counters_stream", lambda b: drained(b, lambda s: live.running_counters(s.tool_events, "tool_name", "success", "timestamp"),
                                               "complete"), f"""
    SELECT tool_name, count(*) AS total_calls, {cif('success = 1')} AS success_count, {cif('success = 0')} AS failure_count,
           max(timestamp) AS last_used FROM tool_events GROUP BY 1""")
query("j06_hourly_windows_stream", lambda b: drained(b, lambda s: live.windowed_counts(
    s.activity_events, "timestamp", "1 hour", ["event_type"]), "complete"), """
    SELECT timestamp // 3600 * 3600 AS window_start, event_type, count(*) AS n FROM activity_events GROUP BY 1, 2""")
ISLANDS = """
    o AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w {join} THEN 0 ELSE 1 END AS nw FROM tool_events
          WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, id)),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY session_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS g FROM o),
    s AS (SELECT session_id, count(*) AS event_count, min(timestamp) AS start_ts, max(timestamp) AS end_ts FROM i
          GROUP BY session_id, g)"""
#: Slices of time that a table of events is dealt to for the streams below: a batch each.
FILES = 6
#: Rows of a file, about: a slice with more is several files, each of a shorter time.
FILE_ROWS = 1 << 20


def arriving(b: Bindings, rows: DataFrame, ts: str, *, tick: int | None = None) -> DataFrame:
    """Rows in :data:`FILES` slices of files, which arrive in the order of their times; the files, read back.

    ``rows`` is computed once for its files. A file is a slice of time, so none brings rows
    that are older than those of the file before it, and all slices have as many files. With ``tick`` a last file holds one row of no session, so many seconds later: the
    clock of the stream moves on and what is still open closes.
    """
    root = folder(b.spark)
    first, last, n = rows.agg(F.min(ts), F.max(ts), F.count(ts)).first()
    files = FILES * max(1, -(-n // (FILES * FILE_ROWS)))
    slice_ = F.floor((F.col(ts) - first) * files / (last - first + 1))
    rows.withColumn("_slice", slice_).write.partitionBy("_slice").parquet(f"{root}-slices")
    dealt = b.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_slice", T.LongType())])).parquet(f"{root}-slices")
    for k in range(files):
        dealt.filter(F.col("_slice") == k).drop("_slice").coalesce(1).write.mode("append").parquet(f"{root}/file={k}")
    if tick is not None:
        later = [F.lit(last + tick if f.name == ts else None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
        b.spark.range(1).select(*later).write.mode("append").parquet(f"{root}/file={files}")
    return b.spark.read.schema(rows.schema).parquet(f"{root}/*")


def stream_of(b: Bindings, files: DataFrame, most: int | None = None) -> DataFrame:
    """A stream over what :func:`arriving` has written; a trigger takes the files of so many slices."""
    paths = files.inputFiles()
    root, each = paths[0].rsplit("/", 2)[0], len(paths) // FILES
    return live.read_stream(b.spark, f"{root}/*", files.schema, max_files=most and most * each)


def streamed(b: Bindings, out: DataFrame) -> DataFrame:
    """Run a stream in append mode over all there is and read what it wrote."""
    root = folder(b.spark)
    out.writeStream.format("parquet").option("path", f"{root}/out").outputMode("append").option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return b.spark.read.schema(out.schema).parquet(f"{root}/out")


DAY_S = 86400
query("j07_session_windows_stream", lambda b: streamed(b, live.stream_sessions(stream_of(
    b, arriving(b, b.tool_events, "timestamp", tick=DAY_S)), "timestamp", "2 hours", ["session_id"])).drop(
    "duration_seconds"), f"WITH {ISLANDS.format(join='< 7200')} SELECT * FROM s")


def streaks_stream(b: Bindings) -> DataFrame:
    """The streaks of ``f01_streaks_per_session`` from a stream, closed by the watermark; the same columns."""
    events = stream_of(b, arriving(b, b.tool_events, "timestamp", tick=DAY_S))
    rows = streamed(b, live.stream_streaks(events, "timestamp", ["session_id"], gap_s=7200, min_s=3600))
    rows = rows.withColumnRenamed("event_count", "tool_count")
    return rows.select("session_id", "start_ts", "end_ts", "duration_seconds", "tool_count", st.average_gap(F.col("duration_seconds")))


query("j07_f01_streaks_stream", streaks_stream, f"""
    WITH {ISLANDS.format(join='<= 7200')} SELECT session_id, start_ts, end_ts, end_ts - start_ts AS duration_seconds,
    event_count AS tool_count, {r('(end_ts - start_ts) / CAST(greatest(event_count - 1, 1) AS DOUBLE)', 2)} AS avg_gap_seconds
    FROM s WHERE end_ts - start_ts >= 3600""")


def expiring(b: Bindings) -> DataFrame:
    """Sessions by their state: those silent for a day have left it."""
    root, silence = folder(b.spark), DAY_S
    table = expiry.gauge_table(b.spark, f"{root}/gauge")
    changes = expiry.session_changes(stream_of(b, arriving(b, b.tool_events, "timestamp"), 1), "session_id",
                                     "timestamp", silence)
    before = b.spark.conf.get(PROVIDER, None)
    b.spark.conf.set(PROVIDER, expiry.ROCKSDB)
    try:
        changes.writeStream.foreachBatch(expiry.keep_changes(table, "gauge")).outputMode("update").option(
            "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        b.spark.conf.set(PROVIDER, before) if before else b.spark.conf.unset(PROVIDER)
    return table.read()


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
query("j08_active_sessions_stream", lambda b: expiring(b).groupBy("open").agg(
    F.count(F.lit(1)).alias("sessions"), F.max("last_seen").alias("newest"), F.min("last_seen").alias("oldest")), """
    WITH l AS (SELECT session_id, max(timestamp) AS last_seen FROM tool_events WHERE session_id IS NOT NULL GROUP BY 1),
    c AS (SELECT max(timestamp) - 3600 AS watermark FROM tool_events WHERE session_id IS NOT NULL)
    SELECT last_seen + 86400 > watermark AS open, count(*) AS sessions, max(last_seen) AS newest, min(last_seen) AS oldest
    FROM l, c GROUP BY 1""")


def counted(b: Bindings) -> DataFrame:
    """Counters from six batches that are written as they are, folded half way, some replayed."""
    root = folder(b.spark)
    table = BatchTable(b.spark, f"{root}/usage", SCHEMAS["tool_usage"], ["tool_name"], span=STREAM_SPAN, **COUNTERS["tool_usage"])
    apply = live.apply_counters(table, "calls")

    def run(batch: DataFrame, k: int) -> None:
        apply(batch, k)
        if k == FILES // 2:
            table.fold(k)
        if k % 2:
            apply(batch, k)

    live.live_panels(stream_of(b, arriving(b, b.tool_events, "timestamp"), 1), run, f"{root}/checkpoint",
                     every=None).start().awaitTermination()
    table.retire()
    return table.read().drop("avg_duration_ms")


query("b06_j05_counter_batches_stream", counted, f"""
    SELECT tool_name, count(*) AS total_calls, {cif('success = 1')} AS success_count, {cif('success = 0')} AS failure_count,
           max(timestamp) AS last_used FROM tool_events GROUP BY 1""")
query("j10_deduplicated_stream", lambda b: per_type(drained(b, lambda s: live.deduplicated(
    s.activity_events.unionByName(s.activity_events), "id", "timestamp"), "append")), PER_TYPE)
query("b13_resumed_stream", lambda b: per_type(drained(b, lambda s: s.activity_events, "append", runs=2)), PER_TYPE)


def published(b: Bindings) -> DataFrame:
    """Events by minute, changed rows sent at each trigger by one stream and at each third by another; all that was sent.

    Of the six batches of the first stream one in two is empty: its filter drops every other file.
    """
    root, at = folder(b.spark), arriving(b, b.activity_events, "timestamp")
    first, last = b.activity_events.agg(F.min("timestamp"), F.max("timestamp")).first()
    slice_ = F.floor((F.col("timestamp") - first) * FILES / (last - first + 1))
    # A key of slice and type: its rows come in one batch.
    panel = lambda batch: batch.groupBy(F.concat_ws("/", slice_, "event_type").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    source = lambda n: stream_of(b, at, n).filter(slice_ % 2 == 0)
    panels = {"each": (panel, "slot", 1), "third": (panel, "slot", 3)}
    for writer in live.divided_panels(source, panels, f"{root}/out", "telemetry", f"{root}/checkpoint", seconds=None):
        writer.start().awaitTermination()
    read = lambda n: b.spark.read.schema("slot string, n bigint").json(f"{root}/out/{n}")
    return read("each").select(F.lit("each").alias("panel"), "slot", "n").unionByName(read("third").select(F.lit("third").alias("panel"), "slot", "n"))


SLOTS = f"""SELECT CAST((timestamp - lo) * {FILES} // (hi - lo + 1) AS VARCHAR) || '/' || event_type AS slot, count(*) AS n
    FROM activity_events, (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM activity_events)
    WHERE (timestamp - lo) * {FILES} // (hi - lo + 1) % 2 = 0 GROUP BY 1"""
query("j01_j02_j03_published_panels", published, f"""
    SELECT 'each' AS panel, * FROM ({SLOTS}) UNION ALL SELECT 'third', * FROM ({SLOTS})""")


def interval_stream(b: Bindings) -> DataFrame:
    """Events and the sessions of tool calls around them, both from streams.

    The stream writes lists of events and of sessions that all contain them, and the pairs are made as they are read:
    with the users and the events the pairs grow with the square, the lists with the events.
    """
    root = folder(b.spark)
    st.sessionize(b.tool_events, "timestamp", gap_s=7200, min_s=0, keys=["session_id"]).select(
        "session_id", "start_ts", "end_ts").write.parquet(f"{root}/sessions")
    sessions = b.spark.read.parquet(f"{root}/sessions")
    longest = sessions.agg(F.max(F.col("end_ts") - F.col("start_ts"))).first()[0]
    spans = stream_of(b, arriving(b, sessions, "start_ts"), 1)
    points = stream_of(b, arriving(b, b.activity_events.select(F.col("id").alias("event_id"), F.col("timestamp").alias("at_ts")), "at_ts"), 1)
    pairs = stream_interval_join(points, spans, at="at_ts", start="start_ts", end="end_ts", longest_s=max(4, longest or 4),
                                 watermark="1 day", through=lambda lists: streamed(b, lists))
    return pairs.select("event_id", "session_id", "start_ts")


query("d05_interval_join_stream", interval_stream, f"""
    WITH {ISLANDS.format(join='<= 7200')} SELECT a.id AS event_id, s.session_id, start_ts FROM activity_events a
    JOIN s ON start_ts <= a.timestamp AND end_ts >= a.timestamp""")


def run_log(b: Bindings) -> DataFrame:
    """What the log of the runs says of a stream of six batches."""
    root = folder(b.spark)
    log = RunLog(b.spark, f"{root}/log", every=4)
    b.spark.streams.addListener(log)
    try:
        events = observed(stream_of(b, arriving(b, b.tool_events, "timestamp"), 1), "timestamp")
        q = events.writeStream.queryName(f"tools_{uuid.uuid4().hex}").format("parquet").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        if not log.wait(q.id):
            raise RuntimeError("the stream's end was not reported")
    finally:
        b.spark.streams.removeListener(log)
    return read_log(b.spark, f"{root}/log").select("batch_id", "rows", "newest")


query("m01_run_log", run_log, f"""
    SELECT CAST((timestamp - lo) * {FILES} // (hi - lo + 1) AS BIGINT) AS batch_id, count(*) AS rows, max(timestamp) AS newest
    FROM tool_events, (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM tool_events) GROUP BY 1""")


def registered(b: Bindings) -> DataFrame:
    """A metric from outside, exported with the panels and published by a stream."""
    root = folder(b.spark)
    lake = TelemetryStore(b.spark, f"{root}/lake")
    lake.append("tool_events", b.tool_events)
    lake.register_metric("failed_calls", lambda store, *, as_of, day: store.table("tool_events").filter(
        f"timestamp <= {as_of} AND success = 0").groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls")), "tool_name")
    pn.export_panels(lake.panels(as_of=EVENTS_NOW, day=EVENTS_DAY), f"{root}/panels", ["failed_calls"])
    live_ = lake.live_metrics(lambda: (EVENTS_NOW, EVENTS_DAY))
    hashes = {n: live.hash_table(b.spark, f"{root}/hashes/{n}", key) for n, (_, key) in live_.items()}
    live.live_panels(stream_of(b, arriving(b, b.tool_events, "timestamp"), 3), live.publish_changes(
        live_, hashes, f"{root}/live", "metrics"), f"{root}/checkpoint", every=None).start().awaitTermination()
    read = lambda at: b.spark.read.schema("tool_name string, calls bigint").json(at).select("tool_name", "calls")
    return read(f"{root}/panels/failed_calls").withColumn("sent", F.lit("export")).unionByName(
        read(f"{root}/live/failed_calls").withColumn("sent", F.lit("stream")))


query("k01_registered_metric", registered, """
    SELECT tool_name, count(*) AS calls, sent FROM tool_events, (VALUES ('export'), ('stream')) v(sent)
    WHERE timestamp <= 1706659200 AND success = 0 GROUP BY 1, 3""")


# ---- indexes ------------------------------------------------------------------

BM25 = r"""
    WITH w AS (SELECT doc_id, source, lang AS category, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
               FROM documents),
    st AS (SELECT count(*) AS n, sum(len(ws)) / CAST(count(*) AS DOUBLE) AS mean FROM w),
    q AS (SELECT unnest([%s]) AS term),
    tf AS (SELECT doc_id, source, category, len(ws) AS dl, term, len(list_filter(ws, lambda x: x = term)) AS tf FROM w, q),
    df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1)
    SELECT doc_id, source, category, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean)))), 6)
           AS score FROM tf JOIN df USING (term), st WHERE tf > 0%s GROUP BY 1, 2, 3 ORDER BY score DESC, doc_id LIMIT 20"""


def searched(b: Bindings, words: str, **filters: str) -> DataFrame:
    index = text_index.build(b.documents, folder(b.spark), id_col="doc_id", text="text", category="lang")
    hits = index.search(words, limit=20, **filters)
    return hits.select("doc_id", "source", F.col("lang").alias("category"), F.round("score", 6).alias("score"))


query("l26_index_search", lambda b: searched(b, "river the garden"), BM25 % ("'garden', 'river', 'the'", ""))
query("l26_index_search_filtered", lambda b: searched(b, "and with stone", source="src1", category="en"),
      BM25 % ("'and', 'stone', 'with'", " AND source = 'src1' AND category = 'en'"))
ASKED = "vec_id % 50 = 0"


def vectors(b: Bindings, *probes: int | None) -> list[DataFrame]:
    """A search of one index for each of ``probes``."""
    index = vector_index.build(b.embeddings, folder(b.spark), id_col="vec_id", vec="embedding")
    return [index.search(b.embeddings.filter(ASKED), query_id="vec_id", vec="embedding", probes=n) for n in probes]


query("l26_vector_index_exact", lambda b: vectors(b, 0)[0].select("query_id", "rank", "vec_id"), f"""
    SELECT query_id, rank, vec_id FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
    list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, v.vec_id) AS rank
    FROM embeddings v, (SELECT * FROM embeddings WHERE {ASKED}) q) WHERE rank <= 10""")
query("l26_vector_index_recall", lambda b: vector_index.recall(*vectors(b, None, 0), "vec_id").select(
    "queries", (F.col("recall") >= 0.9).alias("recalled")), f"""
    SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE {ASKED}""")
