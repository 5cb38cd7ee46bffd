"""Streaks, transitions, percentiles and interval joins against brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.operators import joins, streaks, windows
from tracewell.operators.ordering import newest_per_key, packed, rows_at
from tracewell.sinks.upserts import last_rows

EVENTS = "id long, timestamp long, session_id string, tool_name string, context string"


def brute_streaks(times, gap, minimum):
    out, run = [], []
    for t in sorted(times):
        if run and t - run[-1] > gap:
            out.append(run)
            run = []
        run.append(t)
    if run:
        out.append(run)
    return sorted((r[0], r[-1], len(r)) for r in out if r[-1] - r[0] >= minimum)


def spark_streaks(spark, times, gap, minimum, bucket=86400):
    df = spark.createDataFrame([(t,) for t in times], "ts long")
    got = streaks.sessionize(df, "ts", gap_s=gap, min_s=minimum, bucket_seconds=bucket)
    return sorted((r.start_ts, r.end_ts, r.tool_count) for r in got.collect())


@pytest.mark.parametrize("times,want", [
    ([0, 30, 60], [(0, 60, 3)]),                 # a gap of exactly 30 joins
    ([0, 31, 62, 93], []),                       # 31 splits
    ([0, 29, 59], []),                           # 59 seconds are dropped
    ([5], []),                                   # a single event
    ([0, 30, 60, 200, 230, 260], [(0, 60, 3), (200, 260, 3)]),   # the last run is flushed
    ([86370, 86400, 86430], [(86370, 86430, 3)]),                # across a day
    ([0, 0, 0, 30, 60, 60], [(0, 60, 6)]),       # equal instants
])
def test_streak_cases(spark, times, want):
    assert spark_streaks(spark, times, 30, 60) == want


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=80), st.integers(1, 50), st.sampled_from([60, 100, 700]))
def test_streaks_do_not_depend_on_buckets(spark, times, gap, bucket):
    assert spark_streaks(spark, times, gap, 20, bucket) == brute_streaks(times, gap, 20)


def skewed_events(spark, n=3000):
    """One session owns most events, and one second holds a third of them."""
    rnd, rows = random.Random(7), []
    for i in range(n):
        t = 50_000 if i % 3 == 0 else rnd.randrange(0, 200_000)
        s = "hot" if rnd.random() < 0.7 else f"s{rnd.randrange(20)}"
        rows.append((i, t, s, rnd.choice("ABCD"), rnd.choice(["p", "q", ""])))
    return rows, spark.createDataFrame(rows, EVENTS)


def test_keyed_streaks_with_a_hot_key(spark):
    rows, df = skewed_events(spark)
    got = streaks.sessionize(df, "timestamp", gap_s=600, min_s=100, keys=["session_id"])
    want = []
    for s in {r[2] for r in rows}:
        want += [(s, *x) for x in brute_streaks([r[1] for r in rows if r[2] == s], 600, 100)]
    assert sorted((r.session_id, r.start_ts, r.end_ts, r.tool_count) for r in got.collect()) == sorted(want)


def test_streak_table_lists(spark):
    rows = [(i, 10 * i, "s", "Edit" if i % 3 else "Bash", "/p" if i % 2 else "") for i in range(10)]
    ses = spark.createDataFrame([("x", 0, None), ("y", 5, 9), ("z", -9, 0)], "id string, started_at long, ended_at long")
    r = streaks.autonomy_streaks(spark.createDataFrame(rows, EVENTS), ses, min_s=60).collect()
    assert len(r) == 1 and r[0].projects == ["/p"] and r[0].top_tools == {"Edit": 6, "Bash": 4}
    assert r[0].session_ids == ["x", "z"] and r[0].avg_gap_seconds == 10.0


@pytest.mark.parametrize("keys", [[], ["session_id"]])
@pytest.mark.parametrize("width,blocks", [(1, ()), (700, ()), (10**7, (50,)), (700, (3, 12)), (3600, windows.ID_BLOCKS)])
def test_pairs(spark, keys, width, blocks):
    rows, df = skewed_events(spark, 900)
    got = windows.consecutive_pairs(df, "tool_name", "timestamp", "id", keys=keys, slice_seconds=width,
                                    id_blocks=blocks)
    counts = {(r.previous, r.next): r["count"] for r in got.groupBy("previous", "next").count().collect()}
    want = {}
    for s in ({r[2] for r in rows} if keys else {None}):
        seq = [r[3] for r in sorted((x for x in rows if s is None or x[2] == s), key=lambda x: (x[1], x[0]))]
        for p in zip(seq, seq[1:]):
            want[p] = want.get(p, 0) + 1
    assert counts == want


@pytest.mark.parametrize("n,q", [(1, 0.95), (20, 0.95), (997, 0.95), (997, 0.0), (997, 1.0)])
def test_percentile(spark, monkeypatch, n, q):
    rnd = random.Random(n)
    values = [7.5 if i % 3 == 0 else rnd.uniform(-50, 1000) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted(values)[min(int(n * q), n - 1)]
    assert windows.rank_percentile(df, "v", q).first()[0] == want
    monkeypatch.setattr(windows, "MAX_ORDERED_VALUES", 5)   # forces several rounds
    assert windows.rank_percentile(df, "v", q).first()[0] == want


def test_percentile_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert windows.rank_percentile(df, "v", 0.95).count() == 0
    assert windows.rank_percentile(df, "v", 0.95).count() == 0


@pytest.mark.parametrize("limit", [None, 50])
@pytest.mark.parametrize("seed", [3, 4])
def test_interval_join(spark, limit, seed):
    rnd = random.Random(seed)
    points = sorted({rnd.randrange(0, 500) for _ in range(30)})
    spans = [(i, a, None if i % 5 == 0 else a + rnd.randrange(0, 200)) for i, a in
             enumerate(rnd.randrange(0, 500) for _ in range(60))]
    p = spark.createDataFrame([(x,) for x in points], "at long")
    s = spark.createDataFrame(spans, "id long, s long, e long")
    got = joins.interval_join(p, s, at="at", start="s", end="e", order=[F.col("id")], point_limit=limit)
    want = sorted((t, i) for t in points for i in sorted(
        i for i, a, b in spans if a <= t and (b is None or b >= t))[:5])
    assert sorted((r["at"], r["id"]) for r in got.collect()) == want


def test_interval_join_is_the_same_both_ways(spark):
    """Milliseconds, negative instants, open ends, far bounds, nulls, empty intervals."""
    ms, far = 1_770_000_000_000, 1 << 62
    points = [0, -1, -7, 5, ms, ms + 1, ms + 99, far, -far, 12345678901234567, None]
    spans = [(1, ms, None), (2, -8, -1), (3, 0, ms + 1), (4, -far, far - 1), (5, ms + 50, ms + 40), (6, None, 9), (7, 5, 5),
             (8, -far, None), (9, 12345678901234566, 12345678901234568), (10, far, far)]
    p = spark.createDataFrame([(x,) for x in points], "at long")
    s = spark.createDataFrame(spans, "id long, s long, e long")
    run = lambda limit: sorted((r["at"], r["id"]) for r in joins.interval_join(
        p, s, at="at", start="s", end="e", order=[F.col("id")], point_limit=limit).collect())
    want = sorted((t, i) for t in points if t is not None for i in sorted(
        i for i, a, b in spans if a is not None and a <= t and (b is None or b >= t))[:5])
    inside = lambda rows: [x for x in rows if abs(x[0]) < far]
    assert inside(run(None)) == inside(want) and inside(run(20)) == inside(want)
    for limit in (None, 20):
        bad = s.union(spark.createDataFrame([(11, -far - 1, 0)], s.schema))
        with pytest.raises(Exception, match="a bound or point is out of range"):
            joins.interval_join(p, bad, at="at", start="s", end="e", order=[F.col("id")], point_limit=limit).collect()
    with pytest.raises(Exception, match="more points than point_limit"):
        run(3)


def test_calendar_fill(spark):
    df = spark.createDataFrame([("2024-02-28", 3), ("2024-03-02", 4)], "d string, n long")
    got = [(r.d, r.n) for r in joins.calendar_fill(df, "d", ["n"]).orderBy("d").collect()]
    assert got == [("2024-02-28", 3), ("2024-02-29", 0), ("2024-03-01", 0), ("2024-03-02", 4)]


def test_trailing_and_trend(spark):
    df = spark.createDataFrame([(i, None if i == 2 else float(i)) for i in range(1, 11)], "d int, v double")
    t = {r.d: r.trailing for r in windows.trailing_mean(df, "d", "v", 3).collect()}
    assert (t[1], t[2], t[3], t[10]) == (1.0, 1.0, 2.0, 9.0)
    s = {r.d: r.trailing for r in windows.trailing_mean(df, "d", "v", 3, strict=True).collect()}
    assert s[2] is None and s[3] == 2.0
    days = spark.createDataFrame([(i, i) for i in range(1, 15)], "d int, v long")
    r = windows.period_over_period(days, "d", "v").first()
    assert (r.current, r.previous) == (77, 28) and r.change_pct == 175.0
    assert windows.period_over_period(days.filter("d < 8"), "d", "v").first().change_pct is None


def test_dominant_keeps_ties(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "g string, v string")
    assert sorted((r.g, r.v) for r in joins.dominant(df, "g", "v").collect()) == [("a", "x"), ("a", "y"), ("b", "z")]
    assert {r.g: r.v for r in joins.most_frequent(df, "g", "v").collect()} == {"a": "x", "b": "z"}


def test_newest_per_key(spark):
    df = spark.createDataFrame([("k", 1, {"a": 1}), ("k", 2, {"a": 2}), ("j", 1, None)], "k string, v long, m map<string,int>")
    got = {r.k: (r.v, r.m) for r in newest_per_key(df, ["k"], ["v"]).collect()}
    assert got == {"k": (2, {"a": 2}), "j": (1, None)}


def test_section_falls_back_to_the_tail(spark):
    lines = [(i, x) for i, x in enumerate(["a", "SESSION 2024-01-01", "b", "SESSION 2024-01-02", "c", " ", "d"])]
    df = spark.createDataFrame(lines, "n long, t string")
    run = lambda day, **kw: sorted(r.t for r in windows.section_lines(df, "n", "t", "SESSION", day, **kw).collect())
    assert run("2024-01-02", most=1) == ["d"] and run("2024-09-09", fallback=2) == ["c", "d"]
    assert run("2024-01-02", fallback=1) == ["c", "d"] and run("2024-01-01") == ["b"]
    assert run("2024-09-09") == ["SESSION 2024-01-01", "SESSION 2024-01-02", "a", "b", "c", "d"]


def test_winning_rows_with_ties_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 1, "y"), ("a", 2, 1, "z"), ("a", 2, None, "w"), (None, 1, 1, "n"), (None, 1, -3, "m"),
                                ("b", None, 7, "q"), ("b", None, 9, "r")], "k string, hi bigint, lo bigint, t string")
    assert {r.k: r.t for r in newest_per_key(df, ["k"], ["hi", "lo"]).collect()} == {"a": "z", None: "n", "b": "r"}
    assert {r.k: r.t for r in newest_per_key(df.union(df), ["k"], ["hi", "lo"]).collect()} == {"a": "z", None: "n", "b": "r"}
    assert {(r.k, r.t) for r in rows_at(df, ["k"], "hi", F.min).collect()} == {("a", "x"), (None, "n"), (None, "m"), ("b", "q"), ("b", "r")}
    firsts = windows.first_value(df, "k", "t", ["hi", "lo"], min_length=1, cuts={"v": 5})
    assert {r.k: r.v for r in firsts.collect()} == {"a": "x", None: "m", "b": "q"}
    best = windows.arg_max(df, "hi", ["t"], ["t"], ["k"])
    assert {r.k: r.t for r in best.collect()} == {"a": "w", None: "m"}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-4 * 10**18, 4 * 10**18) | st.integers(-2, 2), st.integers(-1 << 63, (1 << 63) - 1) | st.integers(-2, 2)),
                min_size=2, max_size=30))
def test_packed_pairs_order_like_pairs(spark, pairs):
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", packed("a", "b").alias("p"))
    got = sorted(df.collect(), key=lambda r: r.p)
    assert [(r.a, r.b) for r in got] == sorted(pairs)


def test_last_rows(spark):
    """Equal rows of a key are one, maps included; different ones need an order that tells them apart."""
    rows = [("a", 1, {"x": 1}), ("a", 2, {"x": 2}), ("a", 2, {"x": 2}), (None, 3, None), (None, 3, None), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, v bigint, m map<string,int>")
    assert {r.k: (r.v, r.m) for r in last_rows(df, ["k"], ["v"]).collect()} == {"a": (2, {"x": 2}), None: (3, None), "b": (None, None)}
    assert last_rows(df.filter("v = 2 OR k IS NULL"), ["k"]).count() == 2
    assert last_rows(df.limit(0), ["k"]).count() == 0
    with pytest.raises(Exception, match="several new rows"):
        last_rows(df, ["k"]).collect()


def test_interval_join_of_equal_intervals(spark):
    """Of many intervals with the same bounds the first few by the order are found."""
    p, s = spark.createDataFrame([(5,)], "at long"), spark.range(50).selectExpr("id", "id * 0 AS s", "id * 0 + 1000 AS e")
    got = joins.interval_join(p, s, at="at", start="s", end="e", order=[F.col("id")], max_matches=3)
    assert sorted(r.id for r in got.collect()) == [0, 1, 2]
