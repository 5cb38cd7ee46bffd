"""Streaming forms agree with the batch forms, also after a replay."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.operators import streaks, tools
from tracewell.plans.bindings import Bindings
from tracewell.plans.catalogue import files_streams
from tracewell.schemas import SCHEMAS
from tracewell.sinks.batches import STREAM_SPAN, BatchTable
from tracewell.store import COUNTERS
from tracewell.streaming import expiry, export, joins, live, run_log
from tracewell.streaming.joins import stream_interval_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Tool events as files of a lake, several of them, in time order."""
    root = str(tmp_path_factory.mktemp("lake"))
    df = Bindings(spark, SF).tool_events
    lo, hi = df.agg(F.min("timestamp"), F.max("timestamp")).first()
    part = F.floor((F.col("timestamp") - lo) * 4 / (hi - lo + 1))
    for i in range(4):      # one file after the other, so that they arrive in time order
        df.filter(part == i).coalesce(1).write.mode("append").parquet(f"{root}/tool_events")
    return f"{root}/tool_events", df


def stream(spark, lake):
    return live.read_stream(spark, lake[0], lake[1].schema, max_files=1)


def drain(df, name, mode, tmp_path):
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_windowed_counts(spark, lake, tmp_path):
    got = drain(live.windowed_counts(stream(spark, lake), "timestamp", "1 day", ["tool_name"]), "w", "append", tmp_path)
    rows = {(r.window_start, r.tool_name): r.n for r in got.collect()}
    batch = lake[1].groupBy((F.floor(F.col("timestamp") / 86400) * 86400).alias("d"), "tool_name").count().collect()
    want = {(r.d, r.tool_name): r["count"] for r in batch}
    last = max(d for d, _ in want)
    assert rows == {k: v for k, v in want.items() if k[0] < last}   # the last window is still open


def test_sessions_match_batch(spark, lake, tmp_path):
    s = live.stream_sessions(stream(spark, lake), "timestamp", "7200 seconds", ["session_id"], min_s=60)
    got = {(r.session_id, r.start_ts, r.end_ts, r.event_count) for r in drain(s, "s", "append", tmp_path).collect()}
    batch = {(r.session_id, r.start_ts, r.end_ts, r.tool_count) for r in streaks.sessionize(
        lake[1], "timestamp", gap_s=7200, min_s=60, keys=["session_id"]).collect()}
    newest = lake[1].agg(F.max("timestamp")).first()[0]
    closed = {b for b in batch if b[2] < newest - 7200 - 3600 - 60}
    assert closed <= got <= batch
    with pytest.raises(ValueError):
        live.stream_sessions(stream(spark, lake), "timestamp", "1 hour", [])


def test_counters_and_gauge(spark, lake, tmp_path):
    c = drain(live.running_counters(stream(spark, lake), "tool_name", "success", "timestamp"), "c", "complete",
              tmp_path / "a")
    assert sum(r.total_calls for r in c.collect()) == lake[1].count()
    seen = drain(live.last_seen(stream(spark, lake), "session_id", "timestamp"), "l", "complete", tmp_path / "b")
    now = lake[1].agg(F.max("timestamp")).first()[0]
    want = lake[1].filter(F.col("timestamp") > now - 86400).select("session_id").distinct().count()
    assert live.active_sessions(seen, 1440, as_of=now).first()[0] == want


def test_duplicates_are_dropped(spark, lake, tmp_path):
    doubled = f"{tmp_path}/in"
    lake[1].unionByName(lake[1]).write.parquet(doubled)
    s = live.read_stream(spark, doubled, lake[1].schema)
    assert drain(live.deduplicated(s, "id", "timestamp"), "d", "append", tmp_path).count() == lake[1].count()


def usage(spark, root):
    return BatchTable(spark, f"{root}/t", SCHEMAS["tool_usage"], ["tool_name"], span=STREAM_SPAN, **COUNTERS["tool_usage"])


def test_counter_table_from_batches(spark, lake, tmp_path):
    table = usage(spark, tmp_path)
    run = live.apply_counters(table, "calls")
    w = live.live_panels(stream(spark, lake), run, f"{tmp_path}/cp", every=None)
    w.start().awaitTermination(180)
    files = sorted(spark.read.parquet(lake[0]).select("_metadata.file_path").distinct().collect(),
                   key=lambda r: spark.read.parquet(r[0]).agg(F.min("timestamp")).first()[0])
    run(spark.read.parquet(files[-1][0]), 3)     # the last batch again
    want = {r.tool_name: r.total_calls for r in tools.calls_by_tool(lake[1]).select(
        "tool_name", F.col("calls").alias("total_calls")).collect()}
    assert {r.tool_name: r.total_calls for r in table.read().collect()} == want


def test_batches_are_known_by_query_and_number(spark, tmp_path):
    table = usage(spark, tmp_path)
    call = spark.createDataFrame([("Read", 1, 9)], "tool_name string, success int, timestamp long")
    run = live.apply_counters(table, "a")
    for batch in (0, 1, 0, 1, 0):       # older batches come again too
        run(call, batch)
    live.apply_counters(table, "b")(call, 0)        # another stream starts at 0
    r = table.read().first()
    assert (r.total_calls, r.last_used) == (3, 9)
    table.fold(1)
    run(call, 0)        # part of the fold
    run(call, 1)
    assert table.read().first().total_calls == 3


def test_changed_panels_only(spark, lake, tmp_path):
    hashes = live.hash_table(spark, f"{tmp_path}/h", "tool_name")
    panel = lambda batch: tools.calls_by_tool(batch.sparkSession.read.parquet(lake[0]))
    run = live.publish_changes({"tools": (panel, "tool_name")}, {"tools": hashes}, f"{tmp_path}/out", "p")
    batch = spark.read.parquet(lake[0]).limit(3)
    read = lambda i: spark.read.schema("tool_name string, calls long").json(
        f"{tmp_path}/out/tools/batch={i}")
    run(batch, 0)
    assert read(0).count() == 5
    run(batch, 1)
    assert read(1).count() == 0        # nothing changed
    run(batch, 1)                      # replay
    run(batch, 0)                      # replay of the first: the same output again
    assert read(1).count() == 0 and read(0).count() == 5


def test_divided_cadence(spark, tmp_path):
    """Two streams of unequal trigger over one source: every row is published once by each, also over a restart."""
    def put(k, names):
        spark.createDataFrame([(n,) for n in names], "tool_name string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    seen = {1: [], 2: []}

    def counting(n):
        def panel(batch):
            seen[n].append(sorted(r[0] for r in batch.collect()))
            return batch.groupBy("tool_name").agg(F.count("*").alias("calls"))
        return panel

    def drain_all():
        source = lambda n: live.read_stream(spark, f"{tmp_path}/in/*", StructType.fromDDL("tool_name string"), max_files=n)
        panels = {"fast": (counting(1), "tool_name", 1), "slow": (counting(2), "tool_name", 2)}
        for w in live.divided_panels(lambda n: source(n).filter("tool_name <> '-'"), panels, f"{tmp_path}/out", "p", f"{tmp_path}/cp", seconds=None):
            w.start().awaitTermination(180)

    for k, names in enumerate(("A", "BC", "-", "-", "D", "E")):
        put(k, names)
    drain_all()
    assert seen == {1: [["A"], ["B", "C"], ["D"], ["E"]], 2: [["A", "B", "C"], ["D", "E"]]}      # empty batches run no panel
    put(6, "F")
    drain_all()
    for name in ("fast", "slow"):
        assert sorted(r.tool_name for r in spark.read.json(f"{tmp_path}/out/{name}").collect()) == list("ABCDEF")


def test_a_panel_is_evaluated_once(spark, tmp_path):
    """What is hashed is what was sent, also when the lake changes meanwhile."""
    lake, hashes = f"{tmp_path}/lake", live.hash_table(spark, f"{tmp_path}/h", "k")
    spark.createDataFrame([("x", 1)], "k string, n long").write.parquet(lake)

    class Racing(BatchTable):
        def write(self, *args, **kwargs):
            spark.createDataFrame([("x", 2)], "k string, n long").write.mode("overwrite").parquet(lake)
            return super().write(*args, **kwargs)

    racing = Racing(spark, hashes.root, hashes.schema, ["k"], span=STREAM_SPAN)
    panel = lambda batch: batch.sparkSession.read.parquet(lake)
    batch = spark.createDataFrame([(1,)], "i int")
    live.publish_changes({"p": (panel, "k")}, {"p": racing}, f"{tmp_path}/out", "q")(batch, 0)
    live.publish_changes({"p": (panel, "k")}, {"p": hashes}, f"{tmp_path}/out", "q")(batch, 1)
    assert sorted(r.n for r in spark.read.json(f"{tmp_path}/out/p").collect()) == [1, 2]


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, expiry.ROCKSDB)
    yield
    spark.conf.unset(name)


def test_closed_sessions_leave_the_state(spark, tmp_path, rocksdb):
    schema = StructType.fromDDL("session_id string, timestamp long")
    batches = [[("a", 1), ("b", 10), ("hot", 20)] + [("hot", 20 + k) for k in range(50)], [("b", 4000), (None, 4000), ("c", None)],
               [("d", 9000)], [("a", 9100), ("d", 9100)], [("e", 30000)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    table, sizes = expiry.gauge_table(spark, f"{tmp_path}/g"), []
    keep = expiry.keep_changes(table, "g")

    def run(batch, k):
        keep(batch, k)
        sizes.append(sorted((r.session_id, r.last_seen, r.open) for r in table.read().collect()))

    changes = expiry.session_changes(live.read_stream(spark, f"{tmp_path}/in/*", schema, max_files=1), "session_id", "timestamp", 3000, watermark="10 minutes")
    q = changes.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sizes[-1] == [("a", 9100, False), ("b", 4000, False), ("d", 9100, False), ("e", 30000, True), ("hot", 69, False)]
    a = [x for rows in sizes for x in rows if x[0] == "a"]
    assert [x for k, x in enumerate(a) if x not in a[:k]] == [("a", 1, True), ("a", 1, False), ("a", 9100, True), ("a", 9100, False)]
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 2     # "e": its last event and its timer


def test_streaks_from_a_stream_with_a_hot_session(spark, tmp_path):
    """One session owns half of the events, many in one second; what closes equals the batch form."""
    rows = [("hot", 5 * (k // 40)) for k in range(4000)] + [(f"s{k % 7}", 3 * k) for k in range(4000)]
    df = spark.createDataFrame(rows, "session_id string, timestamp long")
    for k in range(3):
        df.filter(f"timestamp >= {4000 * k} AND timestamp < {4000 * (k + 1)}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([(None, 900000)], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    out = live.stream_streaks(live.read_stream(spark, f"{tmp_path}/in/*", df.schema, max_files=1), "timestamp", ["session_id"], gap_s=21)
    got = drain(out, "streaks", "append", tmp_path)
    want = streaks.sessionize(df, "timestamp", gap_s=21, min_s=0, keys=["session_id"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(
        (r.session_id, r.start_ts, r.end_ts, r.duration_seconds, r.tool_count) for r in want.collect())
    assert streaks.sessionize(df, "timestamp", gap_s=20, min_s=0, keys=["session_id"]).count() > want.count()     # the bound is inclusive


def test_export_fan_out(spark, tmp_path):
    events = Bindings(spark, SF).sync_events
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    s = live.read_stream(spark, f"{tmp_path}/in", events.schema, max_files=1)
    run = live.export_batches(export.routes(f"{tmp_path}/out"))
    live.live_panels(s, run, f"{tmp_path}/cp", every=None).start().awaitTermination(180)
    d = export.decode(events)
    for name, shape in export.SHAPES.items():
        assert spark.read.json(f"{tmp_path}/out/{name}").count() == shape(d).count(), name
    run(events.limit(4), 0)     # a replayed batch replaces its own output
    live.live_panels(s, run, f"{tmp_path}/cp", every=None).start().awaitTermination(180)


def test_checkpoint_dir():
    def session(**conf):     # the setting is fixed when a session starts
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)))

    assert live.checkpoint_dir(session(spark_checkpoint_dir="/cluster/"), "q", "/mine") == "/cluster/q"
    assert live.checkpoint_dir(session(), "q", "/mine") == "/mine/q"
    with pytest.raises(ValueError):
        live.checkpoint_dir(session(), "q")


def test_intervals_of_two_streams(spark, tmp_path):
    points = spark.createDataFrame([(k, t) for k, t in enumerate([5, 100, 150, 151, 400, 777, None])], "p long, at long")
    spans = spark.createDataFrame([(1, 0, 100), (2, 100, 150), (3, 90, None), (4, 151, 150), (5, None, 9), (6, 399, 800), (7, 777, 777)],
                                  "s long, a long, b long")
    points.coalesce(1).write.parquet(f"{tmp_path}/p/0")
    for k in range(3):
        spans.filter(f"s % 3 = {k}").coalesce(1).write.parquet(f"{tmp_path}/s/{k}")
    read = lambda n, df, most: live.read_stream(spark, f"{tmp_path}/{n}/*", df.schema, max_files=most)
    pairs = stream_interval_join(read("p", points, None), read("s", spans, 1), at="at", start="a", end="b", longest_s=401)
    got = sorted((r.p, r.s) for r in drain(pairs, "pairs", "append", tmp_path).collect())
    rows = [(r.p, r.at) for r in points.collect() if r.at is not None], [tuple(r) for r in spans.collect() if r.a is not None]
    assert got == sorted((p, s) for p, at in rows[0] for s, a, b in rows[1] if a <= at <= (a + 401 if b is None else b))
    with pytest.raises(Exception, match="longer than longest_s"):
        stream_interval_join(points, spans, at="at", start="a", end="b", longest_s=300).collect()


def test_a_crowded_block_is_a_few_lists(spark, tmp_path, monkeypatch):
    """Points and intervals of one time are kept as lists, cut when long; equal rows count each, and times before 1970 too."""
    points = spark.createDataFrame([(k, -50 + k % 90) for k in range(200)] + [(1, -49)], "p long, at long")
    spans = spark.createDataFrame([(k, -60 + k % 80, -20 + k % 80) for k in range(150)] + [(3, -57, -17)], "s long, a long, b long")
    for k in range(2):
        points.filter(f"p % 2 = {k}").coalesce(1).write.parquet(f"{tmp_path}/p/{k}")
        spans.filter(f"s % 2 = {k}").coalesce(1).write.parquet(f"{tmp_path}/s/{k}")
    read = lambda n, df: live.read_stream(spark, f"{tmp_path}/{n}/*", df.schema, max_files=1)
    want = sorted((p, s) for p, at in points.collect() for s, a, b in spans.collect() if a <= at <= b)
    for most in (joins.MOST, 3):
        monkeypatch.setattr(joins, "MOST", most)
        pairs = stream_interval_join(read("p", points), read("s", spans), at="at", start="a", end="b", longest_s=256)
        q = (pairs.select("p", "s").writeStream.format("memory").queryName(f"crowded{most}").option("checkpointLocation", f"{tmp_path}/{most}")
             .trigger(availableNow=True).start())
        q.awaitTermination(180)
        assert sorted(map(tuple, spark.table(f"crowded{most}").collect())) == want and len(want) > 10000
        rows = max(r.stateOperators[0].numRowsTotal for r in q.recentProgress if r.stateOperators)
        assert most == 3 or rows < 700        # a row of state for each row and block: over 1,800


def test_times_between_seconds(spark):
    """Parts of a second lie in the block of the second, and only in the intervals that contain them."""
    points = spark.createDataFrame([(k, -3 + k * 0.25) for k in range(60)] + [(99, None)], "p long, at double")
    spans = spark.createDataFrame([(1, -2.5, 4.25), (2, 0.5, 0.5), (3, 3.75, None), (4, None, 3.0), (5, 8.0, 7.5)], "s long, a double, b double")
    got = stream_interval_join(points, spans, at="at", start="a", end="b", longest_s=7).collect()
    assert sorted((r.p, r.s) for r in got) == sorted(
        (p.p, s.s) for p in points.collect() if p.at is not None for s in spans.collect()
        if s.a is not None and s.a <= p.at <= (s.a + 7 if s.b is None else s.b))


def test_pairs_of_crowded_sessions_are_made_when_read(spark, monkeypatch):
    """What the stream of d05_interval_join_stream writes grows with the events, not with the pairs."""
    calls = [(u * 10 + k, str(u), 5000 + (u * 37) % 900 + 60 * k) for u in range(150) for k in range(8)]
    b = SimpleNamespace(spark=spark, tool_events=spark.createDataFrame(calls, "id long, session_id string, timestamp long"),
                        activity_events=spark.createDataFrame([(i, t) for i, _, t in calls], "id long, timestamp long"))
    written, streamed = [], files_streams.streamed

    def counting(b, out):
        lists = streamed(b, out)
        written.append(lists.count())
        return lists

    monkeypatch.setattr(files_streams, "streamed", counting)
    got = sorted(map(tuple, files_streams.interval_stream(b).collect()))
    starts = {u: 5000 + (int(u) * 37) % 900 for u in {u for _, u, _ in calls}}
    assert got == sorted((i, u, a) for i, _, t in calls for u, a in starts.items() if a <= t <= a + 420)
    assert written[0] * 5 < len(got)


def test_run_log(spark, lake, tmp_path):
    log = run_log.RunLog(spark, f"{tmp_path}/log", every=3)
    spark.streams.addListener(log)
    try:
        s = run_log.observed(stream(spark, lake).filter("tool_name = 'Read'"), "timestamp")
        q = (s.writeStream.queryName("reads").format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
        q.awaitTermination(180)
        assert log.wait(q.id)
    finally:
        spark.streams.removeListener(log)
    rows = run_log.read_log(spark, f"{tmp_path}/log").orderBy("batch_id").collect()
    assert [r.batch_id for r in rows] == [0, 1, 2, 3] and sum(r.rows for r in rows) == lake[1].filter("tool_name = 'Read'").count()
    assert all(r.duration_ms > 0 and r.lag_seconds > 0 for r in rows)
    assert run_log.health(run_log.read_log(spark, f"{tmp_path}/log"), late_s=0).first().late == 4
    assert run_log.read_log(spark, f"{tmp_path}/none").count() == 0


def test_slices_of_several_files_are_one_batch_each(spark, tmp_path, monkeypatch):
    """A slice of many rows is several files in the order of their times, and a trigger takes all of them."""
    monkeypatch.setattr(files_streams, "FILE_ROWS", 10)
    rows = spark.range(150).selectExpr("id", "id * 7 AS at").repartition(5)
    b = SimpleNamespace(spark=spark)
    files = files_streams.arriving(b, rows, "at")
    assert len(files.inputFiles()) == 3 * files_streams.FILES and files.count() == 150
    sizes = []
    files_streams.stream_of(b, files, 1).writeStream.foreachBatch(lambda df, k: sizes.append(df.count())).option(
        "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert sizes == [25] * files_streams.FILES
