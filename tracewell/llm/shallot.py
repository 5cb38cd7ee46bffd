"""k-means whose assignment step is Shallot search.

Each vector keeps its centroid, the one that was second-nearest when it was last
searched, a bound from above on the distance to the first and one from below on the
distance to all others. Where these do not settle a vector, both remembered centroids
are measured and the search starts from the closer one: it goes through that
centroid's neighbours in order of their distance to it, and ends where a neighbour lies
beyond the ball whose radius is the distance to the start plus the distance to the
second-nearest found so far, which shrinks as better ones are met. The bounds only
discard: what survives is compared by whole squared distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import slices, stored

#: Relative error allowed for in the bounds, far above that of a square root or a sum of two.
SLACK = 1e-9
#: Below this, products and sums of doubles are exact.
EXACT = 1 << 53

STATE = T.StructType([
    T.StructField("vec_id", T.LongType(), True), T.StructField("v", T.BinaryType(), True),
    T.StructField("near", T.IntegerType(), True), T.StructField("second", T.IntegerType(), True),
    T.StructField("upper", T.DoubleType(), True), T.StructField("lower", T.DoubleType(), True),
    T.StructField("distance", T.LongType(), True),
    # A row of sums of one task and cluster; the others have null here.
    T.StructField("n", T.LongType(), True), T.StructField("sums", T.ArrayType(T.LongType(), False), True)])


def limit(size: int) -> int:
    """What whole components have to be below, so that squared distances of ``size`` components fit a long."""
    return min(isqrt(((1 << 63) - 1) // size) // 2, 1 << 31)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole squared distances of the rows of ``a`` to those of ``b`` (or to the one ``b``)."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids of one round, their distances, and each one's neighbours from near to far."""

    def __init__(self, at: np.ndarray, moved: np.ndarray | None = None):
        self.at, self.k = at, len(at)
        d = at[:, None, :] - at[None, :, :]
        apart = np.sqrt(np.einsum("ijk,ijk->ij", d, d).astype("f8"))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)
        # Half the way to the nearest other centroid: no other one is as near as that.
        other = apart + np.where(np.eye(self.k, dtype=bool), np.inf, 0)
        self.half = other.min(axis=1) / 2 if self.k else np.zeros(0)
        self.moved = np.zeros(self.k) if moved is None else moved
        most = np.argsort(-self.moved, kind="stable")
        self.most = self.moved[most[0]] if self.k else 0.0
        self.first = most[0] if self.k else 0
        self.next = self.moved[most[1]] if self.k > 1 else 0.0

    def first_search(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest and second-nearest of all centroids for vectors that remember none."""
        rows = np.arange(len(v))
        if 4 * v.shape[1] * max(np.abs(v).max(initial=0), np.abs(self.at).max(initial=0)) ** 2 < EXACT:
            x, c = v.astype("f8"), self.at.astype("f8")
            d = np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)
            d = d.astype("i8")
        else:
            d = np.stack([squared(v, c) for c in self.at], 1)
        near = d.argmin(axis=1)
        best = d[rows, near]
        if self.k == 1:
            return near, near, best, np.full(len(v), -1)
        d[rows, near] = np.iinfo("i8").max
        second = d.argmin(axis=1)
        return near, second, best, d[rows, second]

    def search(self, v: np.ndarray, near: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """(nearest, second-nearest, their squared distances), from two different remembered centroids."""
        d1, d2 = squared(v, self.at[near]), squared(v, self.at[second])
        swap = (d2 < d1) | (d2 == d1) & (second < near)
        near, second = np.where(swap, second, near), np.where(swap, near, second)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, root = near.copy(), np.sqrt(d1.astype("f8"))
        by_start = np.argsort(start, kind="stable")
        cut = np.searchsorted(start[by_start], np.arange(self.k + 1))
        for a in np.flatnonzero(np.diff(cut)).tolist():
            rows = by_start[cut[a]:cut[a + 1]]
            for j, far in zip(self.order[a].tolist(), self.apart[a].tolist()):
                # Whatever is within the second-best distance of the vector is within this ball around the start.
                rows = rows[far <= (root[rows] + np.sqrt(d2[rows].astype("f8"))) * (1 + SLACK)]
                if not len(rows):
                    break
                r = rows[(near[rows] != j) & (second[rows] != j)]
                if not len(r):
                    continue
                d = squared(v[r], self.at[j])
                better = (d < d1[r]) | (d == d1[r]) & (j < near[r])
                up, next_ = r[better], r[~better & (d < d2[r])]
                second[up], d2[up], near[up], d1[up] = near[up], d1[up], j, d[better]
                second[next_], d2[next_] = j, d[~better & (d < d2[r])]
        return near, second, d1, d2

    def assign(self, v: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """New (near, second, upper, lower) of vectors whose bounds are of the round before; see :meth:`search`."""
        near, second, upper, lower = (x.copy() for x in (near, second, upper, lower))
        if self.k == 1:
            return near, second, upper, lower
        upper = (upper + self.moved[near]) * (1 + SLACK)
        lower = np.maximum((lower - np.where(near == self.first, self.next, self.most)) * (1 - SLACK), 0)
        settled = np.maximum(lower, self.half[near] * (1 - SLACK))
        todo = np.flatnonzero(upper >= settled)
        upper[todo] = np.sqrt(squared(v[todo], self.at[near[todo]]).astype("f8")) * (1 + SLACK)
        todo = todo[upper[todo] >= settled[todo]]
        near[todo], second[todo], d1, d2 = self.search(v[todo], near[todo], second[todo])
        upper[todo], lower[todo] = np.sqrt(d1.astype("f8")) * (1 + SLACK), np.sqrt(d2.astype("f8")) * (1 - SLACK)
        return near, second, upper, lower


def kept(vectors: DataFrame, vec_id: str, vector: str, size: int, scale: int) -> DataFrame:
    """(vec_id, v): rows of exactly ``size`` finite components, each the whole number floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * scale))
    # Doubles, so that a not-a-number (the largest of all) and an infinity fail the comparison.
    fits = (F.size(x) == size) & F.forall(x, lambda c: F.coalesce(F.abs(c * scale) < limit(size), F.lit(False)))
    return vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(fits, whole).alias("w")).filter("w IS NOT NULL")


def initial(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes; equal ids go by their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.w for r in rows.orderBy(h, "w").limit(k).collect()], "i8")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """The whole components as little-endian bytes of 32 bits each, a column that Arrow hands over without a copy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("w").flatten().to_numpy().astype("<i4").tobytes()
            ends = pa.array(np.arange(b.num_rows + 1) * 4 * size, pa.int32())
            v = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, ends.buffers()[1], pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), v], ["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id bigint, v binary")


def _round(state: DataFrame, at: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """One assignment: a row of :data:`STATE` for each vector and one of sums for each task and cluster."""
    k, size = at.shape
    names = [f.name for f in STATE.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(at, moved)
        counts, sums = np.zeros(k, "i8"), np.zeros((k, size), "i8")
        for batch in batches:
            for b in slices(batch):
                raw = b.column("v").cast(pa.binary())
                begin = np.frombuffer(raw.buffers()[1], "i4")[raw.offset]
                v = np.frombuffer(raw.buffers()[2], "<i4", b.num_rows * size, int(begin)).reshape(-1, size).astype("i8")
                if moved is None:
                    near, second, d1, d2 = centroids.first_search(v)
                    upper, lower = np.sqrt(d1.astype("f8")) * (1 + SLACK), np.sqrt(np.maximum(d2, 0).astype("f8")) * (1 - SLACK)
                else:
                    near, second, upper, lower = centroids.assign(
                        v, *[b.column(c).to_numpy().astype(t) for c, t in (("near", "i8"), ("second", "i8"), ("upper", "f8"), ("lower", "f8"))])
                counts += np.bincount(near, minlength=k)
                order = np.argsort(near, kind="stable")
                there, first = np.unique(near[order], return_index=True)
                sums[there] += np.add.reduceat(v[order], first, axis=0)
                none = pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), raw, pa.array(near.astype("i4")), pa.array(second.astype("i4")), pa.array(upper), pa.array(lower),
                     pa.array(squared(v, at[near])), *none], names)
        some = np.flatnonzero(counts)
        nulls = [pa.nulls(len(some), t) for t in (pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*nulls, pa.array(some.astype("i4")), *[pa.nulls(len(some), t) for t in (pa.int32(), pa.float64(), pa.float64(), pa.int64())],
             pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names)

    return state.mapInArrow(run, STATE)


def _means(state: DataFrame, at: np.ndarray) -> np.ndarray:
    """Whole means of the clusters, rounded down; an empty cluster's centroid stays. k x size sums reach the driver."""
    parts = state.filter("n IS NOT NULL").select("near", "n", F.posexplode("sums").alias("pos", "x"))
    total = parts.groupBy("near", "pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = at.copy()
    for r in total.collect():
        out[r.near, r.pos] = int(r.x) // int(r.n)
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, *, size: int = 64, scale: int = 256,
            vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, near, second, upper, lower, distance) for each kept vector, final centroids).

    Kept are vectors of exactly ``size`` components, all there and finite; each
    becomes floor(scale * x) and has to be below :func:`limit` (about 1.9e8 for 64
    components), or its squared distances would not fit a long: others count as not kept. The first centroids are
    the ``k`` vectors of smallest hash; fewer vectors make fewer centroids, none
    makes no rows. Ties go to the smaller number. A centroid without vectors stays.
    Repeated rows and null ids are vectors like others; other columns are not read.
    The driver holds k * size numbers. Each round's state is written to the
    checkpoint folder, so a lost executor costs its tasks of one round.
    """
    rows = kept(vectors, vec_id, vector, size, scale)
    at = initial(rows, k, seed)
    if not len(at):
        return vectors.sparkSession.createDataFrame([], T.StructType(STATE.fields[:7])), at.reshape(0, size)
    state, moved = _packed(rows, size), None
    for r in range(rounds + 1):
        state = stored(_round(state, at, moved))
        if r < rounds:
            new = _means(state, at)
            moved = np.sqrt(squared(new, at).astype("f8")) * (1 + SLACK)
            at = new
            state = state.filter("n IS NULL")
    return state.filter("n IS NULL").select(*[f.name for f in STATE.fields[:7]]), at


def summary(state: DataFrame, at: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector; ``at`` has a row for each cluster."""
    spark = state.sparkSession
    own = state.groupBy(F.col("near").alias("cluster")).agg(F.sum("distance").alias("cluster_inertia"))
    every = own.agg(F.sum("cluster_inertia").alias("inertia"))
    digests = spark.createDataFrame([(j, sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(at.tolist())],
                                    "cluster int, centroid_sha256 string")
    # At most a row for each centroid.
    clusters = F.broadcast(own.join(F.broadcast(every)).join(F.broadcast(digests), "cluster"))
    return state.select("vec_id", F.col("near").alias("cluster"), "distance").join(clusters, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256) -> str:
    """DuckDB SQL of the query: every vector against every centroid in each round."""
    parts = [f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
             f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS j, v AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) <= {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, j := j)) AS best
  FROM (SELECT vec_id, v, j, CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) AS d
        FROM kept, c{r}) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""s{r} AS (
  SELECT j, i, sum(CAST(x AS BIGINT)) AS s, count(*) AS n
  FROM (SELECT best.j AS j, unnest(v) AS x, unnest(range({size})) AS i FROM a{r}) GROUP BY j, i)""")
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT j, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM s{r} GROUP BY j) m USING (j))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best.j AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON j = best.j"""


SQL = _sql()
