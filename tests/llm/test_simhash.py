import re

import numpy as np
import xxhash
from llm_rows import ODD, by_row

from tracewell.llm import components as C
from tracewell.llm import simhash as S
from tracewell.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, component id) by closing the relation over all pairs."""
    f = np.array([fingerprint(t) for _, t in rows], "u8")
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    label = np.arange(len(f))
    while not np.array_equal(new := np.array([label[n].min() for n in near]), label):
        label = new
    ids = {}
    for (d, _), x in zip(rows, label.tolist()):
        ids[x] = min((v for v in (ids.get(x), d) if v is not None), default=None)
    return sorted([(d, format(int(v), "016x"), ids[x]) for (d, _), v, x in zip(rows, f, label.tolist())], key=repr)


def spread(pairs, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_links_within_buckets(monkeypatch):
    r = np.random.default_rng(1)
    for n, offsets in ((40, 512), (600, 512), (900, 64)):
        monkeypatch.setattr(S, "OFFSETS", offsets)
        f = r.integers(0, 2**64, 5, dtype="u8")[r.integers(0, 5, n)]
        for _ in range(4):
            f = f ^ (np.uint64(1) << r.integers(0, 64, n).astype("u8")) * r.integers(0, 2, n).astype("u8")
        f = np.unique(f)
        bucket = r.integers(0, 2, len(f))
        near = (np.bitwise_count(f[:, None] ^ f[None, :]) <= 3) & (bucket[:, None] == bucket[None, :])
        pairs = S.link(bucket, f, np.full(len(f), -1))
        assert all(near[a, b] for a, b in pairs) and len(pairs) < len(f)
        assert spread(pairs, len(f)) == spread(zip(*np.nonzero(near)), len(f))


def test_blocks_of_every_number_find_all(spark, monkeypatch):
    r = np.random.default_rng(2)
    f = r.integers(0, 2**64, 60, dtype="u8")
    more = np.concatenate([f, f ^ np.uint64(0x8000000000000001), f ^ np.uint64(0x0000810000000001)]).view("i8")
    nodes = spark.createDataFrame([(int(x),) for x in np.unique(more)], "fp long")
    for crowded in (1 << 30, 1 << 3, 0):
        monkeypatch.setattr(S, "CROWDED", crowded)
        for task in (8192, 2):
            got = S.groups(nodes, task_bucket=task).groupBy("root").count().collect()
            assert len(got) == 60 and all(x["count"] == 3 for x in got)


def test_components_of_a_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "x long, y long")
    got = {r.a: r.b for r in C.stars(pairs).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_rows(odd, none):
    out = S.components(odd)
    got = by_row(out.select("doc_id", S.hex_digits("fp").alias("f"), "component_id"), "doc_id", "f", "component_id")
    assert got == brute([d[:2] for d in ODD])
    one = S.one_per_group(odd)
    assert one.columns == odd.columns
    groups = {c for _, _, c in got}
    assert sorted(r.doc_id for r in one.collect()) == sorted(groups)
    assert S.components(none).count() == 0 and S.one_per_group(none).count() == 0


def test_query(spark, small):
    got = by_row(QUERIES["op6_simhash_pivots"](spark, "/root/testdata/sf0.001"), "doc_id", "fingerprint", "component_id")
    assert got == brute([(r.doc_id, r.text) for r in small.collect()])
