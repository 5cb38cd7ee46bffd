"""Quality classifier: histogram gradient-boosted trees over document statistics.

A pass over the texts leaves a short vector of statistics for each document. Trees are
grown on a bounded sample of labelled vectors, from histograms of gradients over at
most 64 bins a feature, and flattened: a forest is three arrays (feature and bin of
each inner node, value of each leaf), so a batch of documents walks all trees at once
by indexing in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import annotate, checkpointed, raw

#: Labelled documents that a model is fitted on, about; a larger set is thinned by a hash of the id.
SAMPLE = 20_000
ROUNDS, DEPTH, BINS, RATE, SHRINK, LEAST = 80, 4, 64, 0.15, 1.0, 2.0
THRESHOLD = 0.3

FEATURES = ("log_chars", "log_words", "word_mean", "word_spread", "word_longest", "distinct_words", "top_word",
            "repeated_pairs", "repeated_fives", "symbols", "exclamations", "upper", "digits", "stops", "commas", "marks",
            "line_words", "repeated_lines", "wide_bytes", "entropy", "symbol_words", "title_words")

_KINDS = np.zeros((256, 9), bool)
for _k, _set in enumerate((b"#*$%&|<>", b"!", bytes(range(65, 91)), b"0123456789", b".", b",", b"\"'()-:;?/=+_@[]{}~^`\\",
                           bytes(range(97, 123)), bytes(range(128, 256)))):
    _KINDS[list(_set), _k] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MARKED = tuple(b"#*$%&|<>!")


def _repeated(values: np.ndarray) -> float:
    """Share of the values that are equal to an earlier one."""
    if not len(values):
        return 0.0
    ordered = np.sort(values)
    return float(np.count_nonzero(ordered[1:] == ordered[:-1])) / len(values)


def statistics(data: bytes) -> list[float]:
    """The features of one text; all zero for a text without words."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, "u1"), minlength=256)
    symbols, bangs, upper, digits, stops, commas, marks, lower, wide = (counts @ _KINDS).tolist()
    solid = len(data) - int(counts[[9, 10, 11, 12, 13, 32]].sum())
    sizes = np.fromiter(map(len, words), "i8", n)
    h = np.fromiter(map(hash, words), "i8", n).view("u8")
    ordered = np.sort(h)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    pairs = h[:-1] * _STEP + h[1:]
    fives = (pairs[:-3] * _STEP + pairs[2:-1]) * _STEP + h[4:] if n >= 5 else h[:0]
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = counts[counts > 0] / len(data)
    ends = np.fromiter((w[-1] in _MARKED for w in words), bool, n)
    titles = np.fromiter((65 <= w[0] <= 90 for w in words), bool, n)
    return [np.log1p(len(data)), np.log1p(n), sizes.mean(), sizes.std(), min(sizes.max(), 1000.0), len(starts) / n,
            np.diff(np.r_[starts, n]).max() / n, _repeated(pairs), _repeated(fives), symbols / solid, bangs / solid,
            upper / max(1, upper + lower), digits / solid, stops / n, commas / n, marks / solid, np.log1p(n / len(lines)),
            1 - len(set(lines)) / len(lines), wide / solid, -(share * np.log2(share)).sum(), ends.mean(), titles.mean()]


def features(docs: DataFrame, text: str = "text", *, name: str = "stats", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``name`` whose ``values`` are :data:`FEATURES`."""
    fields = T.StructType([T.StructField("values", T.ArrayType(T.FloatType(), False), False)])

    def work(col: pa.Array) -> tuple[pa.Array]:
        rows = np.array([statistics(b) for b in raw(col)], "f4").reshape(-1, len(FEATURES))
        ends = np.arange(len(rows) + 1, dtype="i4") * len(FEATURES)
        return (pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel())),)

    return annotate(docs, [text], fields, lambda: work, name, keep)


@dataclass
class Forest:
    """Complete binary trees of one depth, level by level; an inner node sends bins above ``bin`` right."""

    edges: list[np.ndarray]      # of each feature, ascending
    feature: np.ndarray          # trees x inner nodes
    bin: np.ndarray              # trees x inner nodes
    leaf: np.ndarray             # trees x leaves
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1).astype("u1")

    def margin(self, bins: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        t, rows = np.arange(trees)[None, :], np.arange(len(bins))[:, None]
        at = np.zeros((len(bins), trees), "i8")
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (bins[rows, self.feature[t, at]] > self.bin[t, at])
        return self.start + self.leaf[t, at - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-self.margin(self.binned(x)))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Forest:
    """Boosted trees on log loss; without both labels the forest is a constant."""
    inner, leaves, width = 2**depth - 1, 2**depth, x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if len(x) else np.zeros(0)
             for k in range(width)]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    rounds = rounds if 0 < y.sum() < len(y) else 0
    out = Forest(edges, np.zeros((rounds, inner), "i4"), np.full((rounds, inner), 255), np.zeros((rounds, leaves)),
                 float(np.log(rate / (1 - rate))))
    bins = out.binned(x) if rounds else None
    margin = np.full(len(y), out.start)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, hess, at = p - y, p * (1 - p), np.zeros(len(y), "i8")
        for level in range(depth):
            nodes = 2**level
            slot = at - (nodes - 1)
            best, which, cut = np.full(nodes, 1e-6), np.zeros(nodes, "i4"), np.full(nodes, 255)
            for k in range(width):
                key = slot * 256 + bins[:, k]
                left_g, left_h = (np.bincount(key, w, nodes * 256).reshape(nodes, 256).cumsum(1) for w in (g, hess))
                sum_g, sum_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + SHRINK) + (sum_g - left_g)**2 / (sum_h - left_h + SHRINK) - sum_g**2 / (sum_h + SHRINK)
                gain[(left_h < LEAST) | (sum_h - left_h < LEAST)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(nodes), top]
                better = value > best
                best[better], which[better], cut[better] = value[better], k, top[better]
            out.feature[t, nodes - 1:2 * nodes - 1], out.bin[t, nodes - 1:2 * nodes - 1] = which, cut
            at = 2 * at + 1 + (bins[np.arange(len(y)), out.feature[t, at]] > out.bin[t, at])
        slot = at - inner
        out.leaf[t] = -RATE * np.bincount(slot, g, leaves) / (np.bincount(slot, hess, leaves) + SHRINK)
        margin += out.leaf[t][slot]
    return out


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of the id as text is a multiple of 5; not for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, by a model learned from ``labels``.

    Learned are only documents that are not held out, one vector for an id and the
    largest of its labels; null labels are passed over. Of more than ``sample`` such
    documents those with the smallest hash of the id are used, about ``sample`` of
    them: that many short vectors, and nothing else, reach the driver. Statistics are
    taken of every whole text, once.

    Null and empty texts have the vector of zeros and its score. Repeated rows get one
    row each and equal scores. Without labels of both kinds every score is the smoothed
    share of label 1; an empty table gives an empty result.
    """
    stats = checkpointed(features(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y")).filter(
        F.col("y").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    learn = stats.join(known, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "stats.values", "y")
    total, grain = learn.count(), 1 << 30
    if total > sample:
        learn = learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < int(grain * sample / total))
    rows = learn.select("values", "y").toArrow()
    x = rows["values"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)).astype("f8")
    forest = fit(x, (rows["y"].to_numpy() > 0.5).astype("f8"))
    fields = T.StructType([T.StructField("score", T.DoubleType(), False)])

    def make():
        return lambda col: (pa.array(forest.score(col.field("values").flatten().to_numpy().reshape(-1, len(FEATURES)))),)

    scored = annotate(stats, ["stats"], fields, make, "made", ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("made.score").alias("score"),
                         (F.col("made.score") >= THRESHOLD).cast("int").alias("predicted"))
