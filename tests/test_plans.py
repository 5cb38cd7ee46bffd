"""Plan assertions: no products, no Python, filters in the scan, small single partitions."""

import re

import pytest

import __spark_entry__  # noqa: F401
from tracewell.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
# Joins of the 50 longest streaks (a limit) against the sessions streamed past them.
NESTED_LOOP_OK = {"b09_autonomy_streaks_table", "d05_open_sessions_at_streaks"}


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")     # whole schemas
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products_and_no_python(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p or name in NESTED_LOOP_OK
    assert not re.search(r"(Python|Pandas|Arrow)\w*", p)


@pytest.mark.parametrize("name", ["e14_tool_usage_summary", "e49_expertise_heatmap", "e40_routing_stats",
                                  "a10_since", "e13_dashboard_summary"])
def test_time_bound_reaches_the_scan(spark, name):
    p = plan(spark, name)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\((ts|l_shipdate)", p)


def test_columns_are_pruned(spark):
    p = plan(spark, "e42_routing_daily")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p)[1]
    assert "l_extendedprice" not in schema and "l_shipdate" in schema
    assert "text" not in re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, "e68_memory_by_source"))[1]


@pytest.mark.parametrize("name", ["b05_j10_upsert_replace", "b08_rate_latest", "e08_l04_l05_l06_transcript_sessions",
                                  "f14_latest_session_per_project", "f18_first_text", "h05_newest_per_key"])
def test_sorting_aggregates_see_winners_only(spark, name):
    """A hash aggregate finds the winning row of a key; what sorts by key lies behind the join that fetches it."""
    p = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
    found = [n.getClass().getSimpleName() for n in nodes(p)]
    assert "HashAggregateExec" in found
    for n in nodes(p):
        if n.getClass().getSimpleName() == "SortAggregateExec":
            assert any(k.getClass().getSimpleName().endswith("JoinExec") for k in nodes(n)), name


def test_section_is_one_bounded_scan(spark):
    p = plan(spark, "f16_section_lines")
    assert p.count("FileScan") == 1
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(", p) and re.search(r"PushedFilters: \[[^\]]*LessThan\(", p)


def nodes(p):
    """All physical nodes below ``p``, through adaptive stages."""
    yield p
    name = p.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(p.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from nodes(p.plan())
    kids = p.children()
    for i in range(kids.size()):
        yield from nodes(kids.apply(i))


@pytest.mark.parametrize("name", [
    "f01_streaks", "f02_f03_transitions", "t21_transitions_global", "f05_latency_all",
    "e97_streak_tools", "f14_longest_session", "f16_section_lines", "d06_calendar_fill", "f10_cumulative_roi"])
def test_single_partition_inputs_are_small(spark, name):
    """What goes through one task is a rollup or slice edges, not the 10,000 events."""
    df = QUERIES[name](spark, SF)
    df.collect()
    for n in nodes(df._jdf.queryExecution().executedPlan()):
        if n.getClass().getSimpleName() == "ShuffleExchangeExec" and "SinglePartition" in n.toString().split("\n")[0]:
            rows = n.metrics().apply("shuffleRecordsWritten").value()
            assert rows <= 4000, (name, rows)
