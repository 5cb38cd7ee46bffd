import zlib

import numpy as np
from llm_rows import ODD

from tracewell.llm import classifier as C
from tracewell.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def walk(forest, x):
    """One tree after the other, node by node."""
    out = []
    for row in x:
        bins = [int(np.searchsorted(e, v, "left")) for e, v in zip(forest.edges, row)]
        total = forest.start
        for f, b, leaf in zip(forest.feature, forest.bin, forest.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (bins[f[at]] > b[at])
            total += leaf[at - len(f)]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_forest():
    r = np.random.default_rng(3)
    x = r.normal(size=(800, len(C.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype("f8")
    forest = C.fit(x, y, rounds=40)
    assert np.allclose(forest.score(x[:50]), walk(forest, x[:50]))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97


def test_one_kind_of_label_gives_a_constant():
    forest = C.fit(np.zeros((5, len(C.FEATURES))), np.ones(5))
    assert np.allclose(forest.score(np.ones((3, len(C.FEATURES)))), 5.5 / 6)
    assert np.allclose(C.fit(np.zeros((0, len(C.FEATURES))), np.zeros(0)).score(np.zeros((1, len(C.FEATURES)))), 0.5)


def test_held_out_accuracy_and_sample(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for sample in (20_000, 150):
        rows = C.classify(docs, labels, sample=sample).collect()
        assert len(rows) == docs.count()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        test = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
        assert len(test) > 50 and sum(a == b for a, b in test) / len(test) > (0.95 if sample > 1000 else 0.85)


def test_labels_held_out_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r.doc_id: r.score for r in C.classify(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (5, 1), (7, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = C.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r.score is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert len({r.score for r in C.classify(odd, labels.limit(0)).collect()}) == 1
    assert C.classify(none, labels).count() == 0


def test_query_columns(spark):
    assert QUERIES["op1_quality_trees"](spark, "/root/testdata/sf0.001").dtypes[:4] == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
