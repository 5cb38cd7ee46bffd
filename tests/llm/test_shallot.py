import math
from hashlib import sha256

import numpy as np
import pytest
from llm_rows import by_row

from tracewell.llm import shallot as S
from tracewell.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<double>, near int, distance string"


def brute(rows, k, rounds, seed, size, scale=256):
    """(id, cluster, squared distance) in whole numbers of any length."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if all(abs(x) < S.limit(size) for x in v)]
    at = [v for _, _, v in sorted((sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v, v) for i, v in kept)][:k]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [[] for _ in at]
        for _, v in kept:
            own[near(v)[1]].append(v)
        at = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, at)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), at


def clusters(spark, rows, k, rounds, size, scale=256):
    state, at = S.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5), k, rounds, 2, size=size, scale=scale)
    return by_row(state, "vec_id", "near", "distance"), at.tolist()


def data(n, size, spread, seed):
    r = np.random.default_rng(seed)
    heart = r.normal(size=(7, size)) * spread
    return [(i, (heart[i % 7] + r.normal(size=size)).tolist(), None, None) for i in range(n)]


@pytest.mark.parametrize("n, k, rounds, size, spread, scale", [
    (300, 12, 5, 3, 4.0, 256), (300, 12, 5, 3, 4.0, 1), (200, 40, 3, 8, 0.1, 2), (60, 1, 2, 2, 1.0, 256), (60, 2, 4, 2, 1.0, 1),
    (20, 40, 3, 4, 1.0, 256), (250, 25, 6, 1, 3.0, 4)])
def test_against_brute_force(spark, n, k, rounds, size, spread, scale):
    rows = data(n, size, spread, n + k)
    rows += [(5, rows[5][1], None, None), (None, rows[9][1], None, None)] + [(1000 + i, rows[3][1], None, None) for i in range(n // 2)]
    assert clusters(spark, rows, k, rounds, size, scale) == brute(rows, k, rounds, 2, size, scale)


def test_bounds_settle_most_vectors_and_change_nothing():
    """Round by round against all distances; far fewer are taken than there are pairs."""
    r = np.random.default_rng(1)
    v = np.concatenate([r.integers(-9, 9, (400, 6)) + c for c in r.integers(-400, 400, (30, 6))])
    at, moved, near, taken = v[r.permutation(len(v))[:30]].copy(), None, None, []
    plain = S.squared
    try:
        for _ in range(6):
            c = S.Centroids(at, moved)
            if near is None:
                near, second, d1, d2 = c.first_search(v)
                upper, lower = np.sqrt(d1) * (1 + S.SLACK), np.sqrt(d2) * (1 - S.SLACK)
            else:
                S.squared = lambda a, b: taken.append(len(a)) or plain(a, b)
                near, second, upper, lower = c.assign(v, near, second, upper, lower)
                S.squared = plain
            every = ((v[:, None] - at[None]) ** 2).sum(2)
            assert (near == every.argmin(1)).all() and (second != near).all()
            root = np.sqrt(every)
            assert (upper >= root[np.arange(len(v)), near]).all()
            root[np.arange(len(v)), near] = np.inf
            assert (lower <= root.min(1)).all()
            new = np.array([v[near == j].sum(0) // max((near == j).sum(), 1) if (near == j).any() else at[j] for j in range(30)])
            moved, at = np.sqrt(plain(new, at)) * (1 + S.SLACK), new
    finally:
        S.squared = plain
    assert sum(taken) < 5 * len(v) * 30 / 4


def test_odd_vectors(spark):
    rows = data(30, 2, 2.0, 3) + [(90, None, 1, "x"), (91, [1.0], 1, "x"), (92, [1.0, None], 1, "x"), (93, [math.nan, 1.0], 1, "x"),
                                  (94, [math.inf, 1.0], 1, "x"), (95, [1.0, 2.0, 3.0], 1, "x"), (96, [], 1, "x"), (97, [1e300, 0.0], 1, "x"),
                                  (98, [-1e6, 1e6], 1, "x"), (99, [-0.0, -1e-9], 1, "x")]
    got = clusters(spark, rows, 4, 3, 2)
    assert got == brute(rows, 4, 3, 2, 2) and {98, 99} <= {i for i, *_ in got[0]} and len(got[0]) == 32


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.summary(*S.cluster(none)).count() == 0
    short = spark.createDataFrame([(1, [1.0], None, None)], SCHEMA)
    assert S.summary(*S.cluster(short)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_query_equals_sql(spark):
    from check_oracle import canon, connect
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op12_shallot_clusters"](spark, sf)
    want = connect(sf).execute(ORACLE_SQL["op12_shallot_clusters"])
    assert canon([tuple(r) for r in rows.collect()], rows.columns) == canon(want.fetchall(), [d[0] for d in want.description])
