from collections import defaultdict
from hashlib import sha256

from llm_rows import ODD, by_row
from pyspark.sql import functions as F

from tracewell.llm import copies as C
from tracewell.llm.queries import ORACLE_SQL, QUERIES


def brute(rows):
    by, seen, out = defaultdict(list), set(), []
    for d, t in rows:
        by[t or ""].append(d)
    for d, t in rows:
        own = by[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        first = (d, t or "") not in seen
        seen.add((d, t or ""))
        out.append((d, keep, len(own), d == keep and first, sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return by_row(df.withColumn("sha", F.lower(F.hex("digest"))), "doc_id", "keep_id", "group_size", "kept", "sha")


def test_odd_rows(spark, odd, none):
    assert result(C.decide(odd)) == brute([r[:2] for r in ODD]) and C.decide(none).count() == C.groups(none).count() == 0


def test_hot_text_and_ties(spark):
    rows = [(i, ("same", "Same", "same ", None, "", f"own {i}")[i % 6 if i % 3 else 0]) for i in range(3000)] + [(7, "x")] * 3 + [(None, "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert result(C.decide(df)) == brute(rows)
    kept = C.decide(df).filter("kept").count()
    assert kept == len({t or "" for _, t in rows}) == C.groups(df).count()


def test_equal_digests_of_different_texts(spark):
    rows = [(i, "abcdef"[:i % 6] + "xy"[i % 2] * (i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    weak = C.decide(df, digest=lambda t: F.length(t) % 3)
    want = sorted(((d, k, n, kept) for d, k, n, kept, _ in brute(rows)), key=repr)
    assert by_row(weak, "doc_id", "keep_id", "group_size", "kept") == want


def test_other_ids_and_names(spark):
    df = spark.createDataFrame([("b", "t", 1), ("a", "t", 2), ("c", None, 3)], "name string, body string, place int")
    assert by_row(C.decide(df, "name", "body"), "doc_id", "keep_id", "kept") == [("a", "b", False), ("b", "b", True), ("c", "c", True)]


def test_plan_is_native(spark, small):
    plan = C.decide(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    combined = C.groups(small)._jdf.queryExecution().executedPlan().toString()
    assert combined.count("HashAggregate") == 4 and "SortAggregate" not in combined       # before and after each of two shuffles


def test_query_equals_sql(spark):
    from check_oracle import canon, connect
    sf = "/root/testdata/sf0.001"
    got, want = QUERIES["op11_exact_copies"](spark, sf), connect(sf).execute(ORACLE_SQL["op11_exact_copies"])
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), [d[0] for d in want.description])
