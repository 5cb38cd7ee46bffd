"""Search indexes and sketches against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import tracewell.plans.catalogue  # noqa: F401
from tracewell.operators import sketches, text_index, vector_index
from tracewell.plans.registry import QUERIES

WORDS = ["the"] * 30 + ["river"] * 6 + ["stone"] * 3 + [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 60))), f"s{i % 3}", "en" if i % 4 else "de") for i in range(600)]
    rows += [(600, None, "s0", "en"), (601, "", "s0", "en"), (602, "River, RIVER!  river_bank", None, None), (603, "ünïted stone", "s1", "en")]
    return rows, spark.createDataFrame(rows, "id long, body string, source string, lang string")


def bm25(rows, query, limit, keep=lambda r: True):
    split = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    words = {r[0]: split(r[1]) for r in rows}
    mean, terms, out = sum(map(len, words.values())) / len(rows), sorted(set(split(query))), []
    df = {t: sum(t in ws for ws in words.values()) for t in terms}
    for r in rows:
        tf, n = Counter(words[r[0]]), len(words[r[0]])
        if keep(r) and any(tf[t] for t in terms):
            out.append((r[0], sum(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * n / mean))
                                  for t in terms if tf[t])))
    return [(d, pytest.approx(s)) for d, s in sorted(out, key=lambda x: (-round(x[1], 9), x[0]))[:limit]]


def test_search_equals_brute_force(spark, docs, tmp_path, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(text_index, "ZONE", 16)      # many zones: most are left out by their bounds
    index = text_index.build(df, str(tmp_path), id_col="id", text="body", category="lang")
    for query, limit in (("river stone", 10), ("the", 5), ("w7 w9 the", 3), ("River", 1), ("ünïted", 4), ("absent", 5), ("stone absent", 700)):
        assert [(r.id, r.score) for r in index.search(query, limit=limit).collect()] == bm25(rows, query, limit), query
    got = index.search("the stone", source="s1", category="en", limit=7)
    assert [(r.id, r.score) for r in got.collect()] == bm25(rows, "the stone", 7, lambda r: r[2] == "s1" and r[3] == "en")
    assert got.columns == ["id", "source", "lang", "score"]
    with pytest.raises(ValueError):
        index.search(" ,")


def test_search_reads_terms_and_no_texts(spark, docs, tmp_path):
    index = text_index.build(docs[1], str(tmp_path), id_col="id", text="body", category="lang")
    plan = index.search("river stone")._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and re.search(r"PartitionFilters: \[bucket#\d+ (IN|INSET) ?\(?", plan) and "In(term" in plan.replace(" ", "")
    assert spark.read.parquet(f"{tmp_path}/postings").agg(F.max(F.size("postings"))).first()[0] <= 2 * text_index.ZONE


def test_empty_texts(spark, tmp_path):
    none = spark.createDataFrame([], "id long, body string, source string, lang string")
    assert text_index.build(none, str(tmp_path), id_col="id", text="body", category="lang").search("x").count() == 0


def test_vectors(spark, tmp_path):
    r = random.Random(4)
    hearts = [[r.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [h + r.gauss(0, 0.4) for h in hearts[i % 9]]) for i in range(900)] + [(900, None), (901, [0.0] * 6), (902, [1.0] * 6), (903, [2.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    index = vector_index.build(df, str(tmp_path), id_col="id", vec="v", cells=32)
    asked = df.filter("id % 50 = 0 OR id > 899")
    exact = index.search(asked, query_id="id", vec="v", limit=5, probes=0)

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    vecs = {r.id: r.v for r in df.collect() if r.v and any(r.v)}
    got = {(r.query_id, r["rank"]): r.similarity for r in exact.collect()}
    assert {q for q, _ in got} == {r.id for r in asked.collect()} & set(vecs)
    for q in {q for q, _ in got}:
        want = sorted((cos(vecs[q], v) for v in vecs.values()), reverse=True)[:5]
        assert [got[q, k + 1] for k in range(5)] == pytest.approx(want)
    found = index.search(asked, query_id="id", vec="v", limit=5, probes=8)      # of 32; these do lie in clusters
    share = vector_index.recall(found, exact, "id").first()
    assert share.queries == 20 and 0.9 <= share.recall <= 1
    assert spark.read.parquet(f"{tmp_path}/vectors").select("cell").distinct().count() > 8
    assert vector_index.recall(index.search(asked, query_id="id", vec="v", limit=5), exact, "id").first().recall >= share.recall


def test_blocks_of_vectors(spark, tmp_path, monkeypatch):
    """Pairs are compared in blocks of bounded size; all ties, copies, repeated and null ids rank as among all pairs."""
    r = random.Random(5)
    vecs = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(300)] + [(1000 - i, [0.3, 0.1, -2.0, 0.7, 0.2]) for i in range(200)]
    vecs += vecs[:40] + [(None, vecs[k][1]) for k in range(0, 60, 7)] + [(7, vecs[8][1]), (2000, None), (2001, [0.0] * 5)]
    vecs += [(3000 + i, [-x * 3 for x in v]) for i, (_, v) in enumerate(vecs[:30])]
    df = spark.createDataFrame(vecs, "id long, v array<double>")
    asked = df.filter("id % 9 = 0 OR id IS NULL OR id > 1990").union(spark.createDataFrame([(5000, [1.0, 2.0]), (5001, [])], df.schema))
    index = vector_index.build(df, str(tmp_path), id_col="id", vec="v", cells=4)
    unit = lambda x: vector_index.unit(F.col(x))
    pairs = df.select("id", unit("v").alias("v")).filter("v IS NOT NULL").crossJoin(
        asked.select(F.col("id").alias("query_id"), unit("v").alias("q")).filter("q IS NOT NULL")).withColumn(
        "similarity", vector_index._dot(F.col("v"), F.col("q")))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    want = pairs.withColumn("rank", F.row_number().over(w))
    key = lambda x: (x[0] is None, x[0], x[1])
    for limit, block, tile in ((10, 1 << 20, 1 << 22), (3, 100, 70), (1000, 150, 900)):
        monkeypatch.setattr(vector_index, "BLOCK", block)
        monkeypatch.setattr(vector_index, "TILE", tile)
        found = index.search(asked, query_id="id", vec="v", limit=limit, probes=0)
        got = sorted(map(tuple, found.select("query_id", "rank", "id", "similarity").collect()), key=key)
        assert got == sorted(map(tuple, want.filter(F.col("rank") <= limit).select("query_id", "rank", "id", "similarity").collect()), key=key)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()      # no row for each pair
    assert index.search(asked, query_id="id", vec="v", limit=0).count() == 0


def test_best_of_a_block():
    v = np.array([[1.0, 0], [0, 1], [np.nan, 0], [1, 0], [1, 0], [0.6, 0.8], [1, 0]])
    assert vector_index._first_copies(v, 2).tolist() == [0, 1, 2, 3, 5]
    i, j, near = vector_index._best(v[[0, 2]], v, 3)
    assert i.tolist() == [0] * 3 + [1] * 3 and j.tolist() == [2, 0, 3, 0, 1, 2]
    assert np.isnan(near).tolist() == [True, False, False, True, True, True] and near[1:3].tolist() == [1, 1]


def test_recall_builds_one_index(spark, monkeypatch):
    built, build = [], vector_index.build
    monkeypatch.setattr(vector_index, "build", lambda *args, **kwargs: built.append(args) or build(*args, **kwargs))
    asked = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert [tuple(r) for r in QUERIES["l26_vector_index_recall"](spark, "/root/testdata/sf0.01").collect()] == [(asked, True)]
    assert len(built) == 1


def test_quantiles_of_days(spark):
    r = random.Random(5)
    rows = [(f"2024-01-{1 + i % 9:02d}", "ab"[i % 2], r.expovariate(1 / 50) * (1 + i % 9)) for i in range(30000)] + [("2024-01-01", "a", None)]
    df = spark.createDataFrame(rows, "d string, k string, x double")
    rollup = sketches.quantile_rollup(df, "k", F.col("d"), "x")
    assert rollup.count() == 18 - 9 or rollup.count() == 18
    for since, until in ((None, None), ("2024-01-03", "2024-01-05"), ("2024-01-09", None)):
        for row in sketches.quantiles(rollup, "k", [0.05, 0.5, 0.95], since=since, until=until).collect():
            own = sorted(x for d, k, x in rows if k == row.k and x is not None and (since or "") <= d <= (until or "9"))
            assert row.n == len(own)
            for p, q in zip((0.05, 0.5, 0.95), row.q):
                assert abs(sum(x <= q for x in own) / len(own) - p) <= sketches.RANK_ERROR


def test_distinct_over_trailing_days(spark):
    r = random.Random(6)
    rows = [(f"2024-02-{d:02d}", r.randrange(9000)) for d in (1, 2, 3, 5, 9) for _ in range(3000)] + [("2024-02-02", None)]
    df = spark.createDataFrame(rows, "d string, s long")
    for keep, exact in ((300, True), (9000, False)):
        some = df.filter(f"s < {keep} OR s IS NULL")
        got = {x.day: x.n for x in sketches.trailing_distinct(sketches.distinct_rollup(some, F.col("d"), "s"), 3).collect()}
        assert sorted(got) == [f"2024-02-{d:02d}" for d in (1, 2, 3, 5, 9)]
        for day, n in got.items():
            d = int(day[-2:])
            want = len({s for x, s in rows if s is not None and s < keep and d - 2 <= int(x[-2:]) <= d})
            assert n == want if exact else abs(n - want) <= 4 * want / math.sqrt(2**sketches.THETA_LG)


def test_build_keeps_no_second_copy_of_the_counts(spark, docs, tmp_path):
    rows, df = docs
    text_index.build(df, str(tmp_path), id_col="id", text="body", category="lang")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["postings", "stats", "terms"]
    words = [set(w for w in re.split(r"[^\w]|_", (r[1] or "").lower()) if w) for r in rows]
    assert {r.term: r.df for r in spark.read.parquet(f"{tmp_path}/terms").collect()} == Counter(w for ws in words for w in ws)
