"""Similar vectors by an inverted file: cells of a coarse quantiser, and a search of the nearest ones.

Unit vectors are quantised to the nearest of some centroids, fitted on a bounded
sample, and lie in a folder for each cell. A search ranks the cells for each query
vector, opens the first few, and compares whole vectors there; with all cells open it
is the exact search. A cell's vectors and the queries that open it meet in blocks of
bounded size, and only the best of each block leave its task.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors for each cell that the centroids are fitted on, at most; all vectors are indexed.
SAMPLE_A_CELL = 256
#: Share of the cells that a search opens unless told otherwise. The given vectors have next to no clusters:
#: of 32 cells, 8 found 0.64 of the ten nearest, 12 found 0.79, 16 found 0.87 and 20 found 0.93 (2,000 vectors, 40
#: queries). Where vectors do lie in clusters, fewer are enough.
PROBED = 0.625
#: Components of the vectors, and of the queries, that meet in one block, about; 8 MB each.
BLOCK = 1 << 20
#: Similarities of a block that are held at once.
TILE = 1 << 22
#: Pairs of blocks that one task compares, about, where there are more of them than shuffle partitions.
PAIRS_A_TASK = 8


def unit(vec: Column) -> Column:
    """The vector as doubles of length one; null where it has none."""
    x = vec.cast("array<double>")
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
    # Inside a lambda the length would be computed anew for every component.
    return F.when(size > 0, F.zip_with(x, F.array_repeat(size, F.size(x)), lambda c, s: c / s))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    return pc.list_flatten(col).to_numpy().reshape(-1, width)


def _first_copies(v: np.ndarray, limit: int) -> np.ndarray:
    """Places of the rows, in order, without those that equal ``limit`` earlier ones."""
    order = np.argsort(v.view(f"V{v.shape[1] * 8}").ravel(), kind="stable")
    same = np.r_[False, (v[order[1:]].view("i8") == v[order[:-1]].view("i8")).all(axis=1)]
    at = np.arange(len(v))
    nth = at - np.maximum.accumulate(np.where(same, 0, at))
    return np.sort(order[nth < limit])


def _best(q: np.ndarray, v: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, similarity) of the ``limit`` best vectors of each query, the earlier of equal ones.

    A matrix product finds the candidates. Its sums are rounded in another order than
    those of :func:`_dot`, so all within the rounding of the last are kept and summed anew.
    """
    slack = 4 * v.shape[1] * np.finfo("f8").eps
    found = []
    step = max(1, TILE // len(v))
    for at in range(0, len(q), step):
        near = q[at:at + step] @ v.T
        near[np.isnan(near)] = np.inf       # not a number comes first, as in Spark's order
        last = np.partition(near, len(v) - limit, axis=1)[:, len(v) - limit, None] if limit < len(v) else -np.inf
        i, j = np.nonzero(near >= last - slack)
        exact = np.zeros(len(i))
        for k in range(v.shape[1]):
            exact += q[at + i, k] * v[j, k]
        order = np.lexsort((j, -np.where(np.isnan(exact), np.inf, exact), i))
        i, j, exact = i[order], j[order], exact[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((at + i[nth < limit], j[nth < limit], exact[nth < limit]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _compare(rows: pa.Table, asked: pa.Table, limit: int) -> pa.Table:
    """(query_id, id, similarity): the ``limit`` best ``rows`` of each of the ``asked``, ties by id; null where lengths differ."""
    rows = rows.take(pc.sort_indices(rows, [("id", "ascending")], null_placement="at_start"))
    width = len(rows["v"][0])
    v = _matrix(rows["v"], width)
    keep = _first_copies(v, limit)
    fit = pc.equal(pc.list_value_length(asked["q"]), width)
    other, asked = asked.filter(pc.invert(fit)), asked.filter(fit)
    parts = []
    if len(asked):
        i, j, near = _best(_matrix(asked["q"], width), v[keep], limit)
        parts.append((asked["query_id"].take(pa.array(i)), rows["id"].take(pa.array(keep[j])), pa.array(near)))
    if len(other):
        n = min(limit, len(rows))
        i, j = np.divmod(np.arange(len(other) * n), n)
        parts.append((other["query_id"].take(pa.array(i)), rows["id"].take(pa.array(j)), pa.nulls(len(i), pa.float64())))
    return pa.concat_tables(pa.table(list(p), ["query_id", "id", "similarity"]) for p in parts)


@dataclass(frozen=True)
class VectorIndex:
    """An index under ``root``, as :func:`build` writes it."""

    spark: SparkSession
    root: str
    id_col: str

    def search(self, queries: DataFrame, *, query_id: str, vec: str, limit: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, rank, id, similarity): the ``limit`` most similar vectors by cosine of each query vector, ties by id.

        ``probes`` cells are opened for each query, by default the share :data:`PROBED`;
        0 opens all of them, which is exact. Queries without a direction find nothing.
        Every block of queries meets every block of the vectors it asks for, and the best
        ``limit`` of each pair of blocks are merged.
        """
        centroids = self.spark.read.parquet(f"{self.root}/centroids")
        cells = centroids.agg(F.array_sort(F.collect_list(F.struct("cell", "centre"))).alias("cells")).scalar()
        n = centroids.agg(F.count(F.lit(1))).scalar()
        opened = {None: F.ceil(n * PROBED), 0: n}.get(probes, F.lit(probes))
        q = queries.select(F.col(query_id).alias("query_id"), unit(F.col(vec)).alias("q")).filter("q IS NOT NULL").withColumn("cells", cells)
        ranked = F.array_sort(F.transform("cells", lambda c: F.struct((-_dot(c.centre, F.col("q"))).alias("far"), c.cell.alias("cell"))))
        asked = q.select("query_id", "q", F.explode(F.slice(ranked, 1, opened.cast("int"))).alias("c")).select("query_id", "q", "c.cell")
        rows = self.spark.read.parquet(f"{self.root}/vectors")
        # How many blocks the vectors of each cell make, and how many the queries.
        sizes = dict(rows.groupBy("cell").agg(F.ceil(F.sum(F.size("v")) / BLOCK)).collect())
        parts = q.agg(F.ceil(F.sum(F.size("q")) / BLOCK)).first()[0] or 1
        pieces = F.get(F.array([F.lit(sizes.get(k, 0)) for k in range(max(sizes, default=0) + 1)]), F.col("cell"))
        numbers = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
        rows = rows.withColumn("piece", F.floor(F.rand(1) * pieces)).withColumn("part", F.explode(numbers(F.lit(parts))))
        asked = asked.filter(pieces > 0).withColumn("part", F.pmod(F.xxhash64("query_id", "q"), F.lit(parts))).withColumn(
            "piece", F.explode(numbers(pieces)))
        keys = ["cell", "piece", "part"]
        pairs_of_blocks = max(1, sum(sizes.values()) * parts)
        # A pair of blocks is few bytes and much work, so the number of partitions is fixed: adaptive execution would merge them.
        tasks = max(min(pairs_of_blocks, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), pairs_of_blocks // PAIRS_A_TASK)
        schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", rows.schema["id"].dataType),
                               T.StructField("similarity", T.DoubleType())])
        empty = to_arrow_schema(schema).empty_table()

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            if len(left) and len(right):
                return _compare(left, right, max(1, limit))
            return empty

        pairs = rows.repartition(tasks, *keys).groupBy(*keys).cogroup(asked.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(
            best, schema).withColumnRenamed("id", self.id_col)
        w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), self.id_col)
        return pairs.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit)


def build(vectors: DataFrame, root: str, *, id_col: str, vec: str, cells: int = 32, seed: int = 1) -> VectorIndex:
    """Write the index of ``vectors`` to ``root``; rows without a direction are left out.

    The centroids are fitted on the :data:`SAMPLE_A_CELL` * ``cells`` rows of the smallest
    id hashes, whatever the size of the table. A cell that owns many vectors is several
    files of one folder, and its join is split like any other skewed one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), unit(F.col(vec)).alias("v")).filter("v IS NOT NULL")
    sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE_A_CELL * cells).select(array_to_vector("v").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{root}/centroids")
    assigned = model.transform(rows.withColumn("features", array_to_vector("v"))).select("id", "v", F.col("prediction").alias("cell"))
    assigned.write.mode("overwrite").partitionBy("cell").parquet(f"{root}/vectors")
    return VectorIndex(spark, root, id_col)


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> DataFrame:
    """(queries, recall): the share of the exact neighbours that were found."""
    keys = ["query_id", id_col]
    hit = exact.select(*keys).join(found.select(*keys).withColumn("hit", F.lit(1)), keys, "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
