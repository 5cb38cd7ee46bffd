"""Near-duplicate detection with SimHash and pivot distance tables.

The table of pivots holds the Hamming distance of every fingerprint to a set of
reference fingerprints. By the triangle inequality two fingerprints within three bits
differ by at most three in each coordinate, so a pair whose largest coordinate
difference is above that is discarded without a look at its bits; survivors are
verified.

Which pairs meet at all is decided by blocks of bits: of ``n`` blocks at least
``n - 3`` are equal in a linked pair. Fingerprints meet in a bucket for each choice of
``n - 3`` blocks, once for each distinct value however many documents share it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import annotate, checkpointed, fresh, raw
from tracewell.llm.components import stars

SEED, SHINGLE, BITS, RADIUS = 42, 3, 64, 3
PIVOTS = np.random.default_rng(20240131).integers(0, 2**64, 16, dtype="u8", endpoint=False)
#: Fingerprints in a bucket on average, before finer blocks are used.
CROWDED = 1024
#: Fingerprints in a bucket that one task compares; larger buckets are cut into chunks of
#: half as many, and the pairs of chunks are compared by tasks of their own.
TASK_BUCKET = 8192
#: Rows in a group of buckets that one call handles.
GROUP_ROWS = 20_000
#: Buckets above this size are compared by rows against columns.
OFFSETS = 512

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGE = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.LongType(), False)])


def fingerprint(data: bytes) -> int:
    """Signed 64-bit SimHash of a text's shingles; 0 for a text without words."""
    import xxhash
    words = data.translate(_LOWER).split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) < SHINGLE:
        hashes = [digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
        starts = [0, *ends[:-1].tolist()]
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1:] - 1).tolist(), strict=False)]
    ones = np.zeros(BITS, "i8")
    for k in range(0, len(hashes), 1 << 16):
        some = np.frombuffer(b"".join(hashes[k:k + (1 << 16)]), "u1").reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", *, name: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a bigint ``name``; null and empty texts have fingerprint 0."""
    made = fresh(docs, "made")
    kept = list(docs.columns if keep is None else keep)
    fields = T.StructType([T.StructField("fp", T.LongType(), False)])
    out = annotate(docs, [text], fields, lambda: lambda col: [(fingerprint(b),) for b in raw(col)], made, kept)
    return out.select(*kept, F.col(f"{made}.fp").alias(name))


# ---- pairs within a group of buckets ----------------------------------------------

class Forest:
    """Union-find over the rows of a group; keeps a spanning set of the pairs it was told."""

    def __init__(self, n: int):
        self.parent, self.pairs = np.arange(n), []

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.parent[i] != self.parent[j]
        if not apart.any():
            return
        p = self.parent
        for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            a, b = x, y
            while p[a] != a:
                a = p[a]
            while p[b] != b:
                b = p[b]
            if a != b:
                p[max(a, b)] = min(a, b)
                self.pairs.append((x, y))
        while not np.array_equal(up := p[p], p):
            p = up
        self.parent = p


def survivors(f: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within the radius: coordinates first, one pivot after the other, then the bits."""
    for k in range(table.shape[1]):
        if not len(i):
            return i, j
        c = table[:, k]
        near = np.abs(c[i] - c[j]) <= RADIUS
        i, j = i[near], j[near]
    near = np.bitwise_count(f[i] ^ f[j]) <= RADIUS
    return i[near], j[near]


def link(bucket: np.ndarray, f: np.ndarray, chunk: np.ndarray) -> list[tuple[int, int]]:
    """Spanning pairs of rows of one bucket within the radius.

    Rows with ``chunk`` below 0 are compared with every row of their bucket, others
    only across chunks.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, f, chunk = bucket[order], f[order], chunk[order]
    table = np.bitwise_count(f[:, None] ^ PIVOTS[None, :]).astype("i2")
    forest = Forest(len(f))

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        open_ = (chunk[i] != chunk[j]) | (chunk[i] < 0)
        forest.unite(*survivors(f, table, i[open_], j[open_]))

    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(f) else np.array([], "i8")
    sizes = np.diff(np.r_[starts, len(f)])
    large = np.repeat(sizes > OFFSETS, sizes)
    for d in range(1, min(OFFSETS, int(sizes.max(initial=0)))):
        i = np.flatnonzero((bucket[:-d] == bucket[d:]) & ~large[:-d])
        if not len(i):
            break
        meet(i, i + d)
    for s, n in zip(starts[sizes > OFFSETS].tolist(), sizes[sizes > OFFSETS].tolist(), strict=True):
        rows = s + np.argsort(table[s:s + n, 0], kind="stable")
        first = table[rows, 0]
        for a in range(0, n, 128):
            end = int(np.searchsorted(first, first[min(a + 127, n - 1)] + RADIUS, "right"))
            i, j = np.meshgrid(np.arange(a, min(a + 128, n)), np.arange(a, end), indexing="ij")
            i, j = rows[i[i < j]], rows[j[i < j]]
            apart = forest.parent[i] != forest.parent[j]
            meet(i[apart], j[apart])
    return [(int(order[x]), int(order[y])) for x, y in forest.pairs]


# ---- buckets ----------------------------------------------------------------------

def masks(n: int) -> list[int]:
    """Signed bit masks of the buckets for ``n`` distinct fingerprints.

    The fewest blocks whose choices tell ``n`` fingerprints apart well enough: 4 blocks
    make 4 buckets of 16 bits for each fingerprint, 5 make 10 of 25, 6 make 20 of 32.
    Every number of blocks finds all pairs.
    """
    for blocks in range(RADIUS + 1, 9):
        cut = [BITS * k // blocks for k in range(blocks + 1)]
        part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:])]
        out = [sum(c) for c in combinations(part, blocks - RADIUS)]
        if n <= CROWDED << min(m.bit_count() for m in out):
            break
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(nodes: DataFrame, fp: str = "fp", *, task_bucket: int = TASK_BUCKET) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within the radius that connect all that are linked.

    ``nodes`` has a row for each distinct fingerprint and should be cheap to read
    twice. Within a task a spanning forest of its links is returned, never all pairs.
    A bucket of more than ``task_bucket`` fingerprints is cut into chunks by hash, and
    each two chunks meet in a bucket of their own, so no task holds more than that.
    """
    n = nodes.count()
    sets = masks(n)
    rows = nodes.select(F.col(fp).alias("f"), F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m)) for m in sets])).alias("t", "v"))
    crowd = rows.groupBy("t", "v").count().filter(F.col("count") > task_bucket)
    rows = rows.join(crowd, ["t", "v"], "left")
    chunks = F.ceil(F.col("count") * 2 / task_bucket).cast("int")
    own = F.pmod(F.xxhash64("f"), chunks).cast("int")
    # The bucket of chunks x <= y has the number x * chunks + y; a chunk meets itself in (x, x).
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda o: F.least(own, o) * chunks + F.greatest(own, o))
    cut = rows.filter(F.col("count").isNotNull()).select("f", "t", "v", own.alias("own"), chunks.alias("chunks"), F.explode(pairs).alias("p"))
    inner = F.col("p") == F.col("own") * F.col("chunks") + F.col("own")
    whole = rows.filter(F.col("count").isNull()).select("f", F.xxhash64("t", "v").alias("bucket"), F.lit(-1).alias("chunk"))
    parts = cut.select("f", F.xxhash64("t", "v", "p").alias("bucket"), F.when(inner, -1).otherwise(F.col("own")).alias("chunk"))
    least = 2 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, n * len(sets) // GROUP_ROWS)
    met = whole.union(parts).withColumn("g", F.pmod(F.xxhash64("bucket", F.lit(1)), F.lit(groups)))

    def pairs_of(table: pa.Table) -> pa.Table:
        f = table["f"].to_numpy()
        found = link(table["bucket"].to_numpy(), f.view("u8"), table["chunk"].to_numpy())
        i, j = np.array(found, "i8").reshape(-1, 2).T
        return pa.table({"a": f[i], "b": f[j]})

    return met.groupBy("g").applyInArrow(pairs_of, _EDGE)


def groups(prints: DataFrame, fp: str = "fp", *, task_bucket: int = TASK_BUCKET) -> DataFrame:
    """(fp, root): every distinct fingerprint with the smallest fingerprint of its component."""
    nodes = checkpointed(prints.select(F.col(fp).alias("fp")).distinct())
    found = stars(links(nodes, task_bucket=task_bucket))
    return nodes.join(found.withColumnRenamed("a", "fp"), "fp", "left").select("fp", F.coalesce("b", "fp").alias("root"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, task_bucket: int = TASK_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id that can be reached over fingerprints at most
    three bits apart, the row's own included; null ids are passed over, and a component
    of null ids has a null one. Null, empty and blank texts share fingerprint 0, which
    links like any other. Repeated rows and ids give a row each. Texts are read once;
    after that only fingerprints and ids move, and those of equal texts are one.
    """
    prints = checkpointed(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]))
    roots = groups(prints, task_bucket=task_bucket)
    lows = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = checkpointed(lows.join(roots, "fp"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id (null ids last), with the columns of ``docs``.

    Of rows alike in id and text one stays. Texts move once, to meet the keys of the
    rows that stay.
    """
    k1, k2, rank = fresh(docs, "k1"), fresh(docs, "k2"), fresh(docs, "rank")
    keyed = docs.withColumns({k1: F.xxhash64(doc_id, text), k2: F.xxhash64(text, F.lit(7), doc_id)})
    prints = checkpointed(fingerprints(keyed.select(doc_id, text, k1, k2), text, keep=[doc_id, k1, k2]))
    first = prints.join(groups(prints), "fp").groupBy("root").agg(
        F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(k1), F.col(k2))).alias("first"))
    stay = first.select(f"first.{k1}", f"first.{k2}")
    same = Window.partitionBy(k1, k2).orderBy(k1)
    kept = keyed.join(stay, [k1, k2], "left_semi").withColumn(rank, F.row_number().over(same))
    return kept.filter(F.col(rank) == 1).select(*docs.columns)
