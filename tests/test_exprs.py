"""Scalar expressions."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import exprs as e
from tracewell.functions import scoring as sc


def values(spark, schema, rows, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


@pytest.mark.parametrize("text,want", [
    (None, None), ("not-a-date", None), ("2026-02-12T10:00:00", 1770890400), ("2026-02-12T10:00:00Z", 1770890400),
    ("2026-02-12T10:00:00+02:00", 1770883200), ("1707700000", 1707700000), ("1707700000000", 1707700000),
    ("1707700000.0", 1707700000), ("4102444800", 4102444800)])
def test_event_ts(spark, text, want):
    assert values(spark, "x string", [(text,)], F.unix_timestamp(e.event_ts("x"))) == [want]


def test_calendar_in_a_time_zone(spark):
    got = spark.createDataFrame([(1704074400,)], "t long").select(
        e.day_of("t"), e.hour_of("t"), e.day_of("t", "America/New_York"), e.hour_of("t", "America/New_York")).first()
    assert tuple(got) == ("2024-01-01", 2, "2023-12-31", 21)


def test_calendar_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = spark.createDataFrame([(1704074400,)], "t long").select(e.datetime_of("t"), e.hour_of("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert tuple(got) == ("2024-01-01 02:00:00", 2)


def test_elapsed_minutes(spark):
    rows = [("1-02:03:04",), ("02:03:04",), ("05:30",), ("7",), ("x",)]
    assert values(spark, "x string", rows, e.elapsed_minutes("x")) == [1440 + 123, 123, 5, 0, 0]


def test_duration_text(spark):
    rows = [(59,), (3661,), (86400 + 61,), (2 * 86400,)]
    assert values(spark, "x long", rows, e.duration_text("x")) == [
        "0:00:59", "1:01:01", "1 day, 0:01:01", "2 days, 0:00:00"]


def test_humanize_and_money(spark):
    rows = [(7.0,), (1234.0,), (2500000.0,), (3e9,)]
    assert values(spark, "x double", rows, e.humanize("x")) == ["7.0", "1.2K", "2.5M", "3.0B"]
    assert values(spark, "x double", [(0.5,), (12.345,), (2500.0,)], e.money_text("x")) == ["$0.5000", "$12.35", "$2.5K"]


def test_falsy_and_aliases(spark):
    rows = [(None,), (0.0,), (0.4,)]
    assert values(spark, "x double", rows, e.truthy_or("x", F.lit(9.0))) == [9.0, 9.0, 0.4]
    df = spark.createDataFrame([("", "b"), (None, ""), ("a", "b")], "p string, q string")
    assert [r[0] for r in df.select(e.nonblank("p", "q", default="u")).collect()] == ["b", "u", "a"]


def test_map_defaults(spark):
    df = spark.sql("select map('a', 1.0D) as m union all select cast(null as map<string,double>)")
    got = [r[0] for r in df.select(e.with_defaults("m", {"a": 0.0, "b": 2.0})).collect()]
    assert got == [{"a": 1.0, "b": 2.0}, {"a": 0.0, "b": 2.0}]


def test_session_rules(spark):
    df = spark.createDataFrame([(3, 0, False), (9, 0, True), (9, 11, False), (21, 0, False), (9, 3, False)],
                               "m int, t int, bad boolean")
    got = [tuple(r) for r in df.select(sc.outcome("m", "t", F.col("bad")), sc.quality_estimate("m", "t")).collect()]
    assert [g[0] for g in got] == ["abandoned", "error", "success", "success", "partial"]
    assert got[2][1] == pytest.approx(1.3)


def test_size_bucket_null_is_last(spark):
    rows = [(0,), (5,), (20,), (50,), (100,), (101,), (None,)]
    assert values(spark, "x int", rows, sc.size_bucket("x")) == [
        "empty", "tiny", "small", "medium", "large", "marathon", "marathon"]


def test_window_advice(spark):
    df = spark.createDataFrame([("CRITICAL", 81, 86, 6), ("OK", 1, 1, 1)], "t string, p int, b int, n int")
    got = [r[0] for r in df.select(sc.window_advice("t", "p", "b", "n")).collect()]
    assert len(got[0]) == 4 and got[1] == ["Session healthy - proceed normally"]


def test_freshness_and_levels(spark):
    rows = [(-1.0,), (0.0,), (60.0,), (61.0,), (1441.0,)]
    assert values(spark, "x double", rows, sc.freshness("x")) == ["offline", "fresh", "fresh", "stale", "offline"]


def test_exact_sums(spark):
    df = spark.createDataFrame([(0.654,), (0.0041,), (None,), (1e17,), (-1e17,)], "v double")
    assert df.agg(e.mean("v")).first()[0] == 0.6581 / 4
    assert df.limit(2).agg(e.rnd(e.mean("v"), 3)).first()[0] == 0.329
    assert spark.createDataFrame([(1e17,), (3e17,)], "v double").agg(e.rnd(e.mean("v"), 2)).first()[0] == 2e17
    assert df.filter("v > 1e20").agg(e.mean("v"), e.exact_sum("v")).first() == (None, None)
    with pytest.raises(Exception, match="(?i)numeric|overflow|cannot be represented"):
        spark.createDataFrame([(1e30,)], "v double").agg(e.exact_sum("v")).first()
