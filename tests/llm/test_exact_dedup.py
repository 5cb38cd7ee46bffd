import random
from collections import Counter
from hashlib import sha256

import pytest
from llm_rows import by_row
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import exact_dedup as X
from tracewell.llm import suffix_array as A
from tracewell.llm.queries import QUERIES


def brute(rows, length=X.LENGTH):
    rows = [(k, (t or "").encode()) for k, t in rows]
    count, out = Counter(d[i:i + length] for _, d in rows for i in range(len(d) - length + 1)), []
    for k, d in rows:
        mask, last = bytearray(len(d)), 0
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                mask[max(i, last):i + length] = b"\1" * (i + length - max(i, last))
                last = i + length
        runs = sum(1 for i in range(len(d)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((k, len(d), sum(mask), runs, sha256(bytes(x for x, m in zip(d, mask) if not m)).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect()], key=repr)


def test_suffix_array():
    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=80).map(str.encode), st.text("a\x00\xff", max_size=40).map(lambda t: t.encode("latin-1"))),
           st.integers(1, 12))
    def check(data, length):
        assert A.suffix_array(data, len(data) + 1).tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        pieces = [data, data[:len(data) // 2], b"abab"]
        count = Counter(p[i:i + length] for p in pieces for i in range(len(p) - length + 1))
        want = [i + length <= len(p) and count[p[i:i + length]] > 1 for p in pieces for i in range(len(p))]
        assert A.repeated_starts(pieces, length).tolist() == want
    check()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    text = ["".join(r.choice("abcdefgh ijk") for _ in range(1800)) for _ in range(4)]
    out = [(None, None), (1, ""), (2, "ab" * 900), (3, "x" * 2000), (4, "x" * 399), (5, "x" * 400), (6, text[0]), (6, text[0]),
           (7, text[1] + text[2][:399]), (8, text[2]), (9, text[1][100:700] + "é" * 300), (None, text[0][:500])]
    for i in range(25):         # near copies
        t = list(text[3])
        for _ in range(r.choice([1, 3, 8])):
            t[r.randrange(1800)] = "Z"
        a = r.randrange(1000)
        out.append((100 + i, "".join(t)[a:a + r.choice([300, 500, 900, 1800])]))
    for i in range(20):         # one passage just too short, between texts of their own
        out.append((200 + i, "".join(r.choice("abcdefgh") for _ in range(300)) + text[0][:390] + "".join(r.choice("abcdefgh") for _ in range(300))))
    return out


def test_against_brute_force(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(X.remove_repeats(df)) == brute(rows)
    monkeypatch.setattr(X, "ARRAY_BYTES", 3000)        # crowded anchors are cut again
    assert result(X.remove_repeats(df)) == brute(rows)


def test_long_text_in_stretches(spark, monkeypatch):
    r = random.Random(6)
    a, b = ("".join(r.choice("abcdefghij") for _ in range(n)) for n in (9000, 700))
    rows = [(1, a[:4000] + b + a[4000:] + b), (2, b[:450])]
    monkeypatch.setattr(X, "STRETCH", 1000)
    assert result(X.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_runs_of_one_byte(spark, monkeypatch):
    """Their blocks do not shrink around longer grams."""
    r = random.Random(7)
    rows = [(1, "0" * 600_000), (2, "x" * 400), (3, "".join(r.choice("abcdefgh") for _ in range(900)))]
    assert result(X.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    monkeypatch.setattr(X, "ARRAY_BYTES", 3000)
    rows = [(n, rows[2][1][n:n + 20] + "-" * n + "end") for n in range(401, 431)] + rows[1:]
    assert result(X.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_many_near_copies_give_each_occurrence_one_row(spark, monkeypatch):
    """The ranges of a block are one row, however often its anchor was cut again."""
    r = random.Random(8)
    text = ["".join(r.choice("abcdefgh ijk") for _ in range(1500)) for _ in range(2)]
    rows = []
    for i in range(400):
        t = list(text[i % 2])
        for _ in range(r.randrange(4)):
            t[r.randrange(1500)] = "YZ"[i % 2]
        rows.append((i, "".join(t)))
    rows += [(0, rows[0][1])] * 300       # one id and text, often
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(X, "ARRAY_BYTES", 3000)
    seen, settle = [], X._settle

    def counted(pieces, level):
        out = settle(pieces, level)
        seen.append((out.count(), out.select("h", "c").distinct().count()))
        assert all(a["b"] < b["a"] for row in out.collect() for a, b in zip(row.ranges, row.ranges[1:]))
        return out

    monkeypatch.setattr(X, "_settle", counted)
    got = result(X.remove_repeats(df))
    monkeypatch.setattr(X, "_settle", settle)
    assert got == brute(rows) and len(seen) > 2 and all(n == blocks for n, blocks in seen)


def test_suffixes_at_anchors():
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.text("ab", max_size=60), st.text("a\x00", max_size=60)).map(str.encode), min_size=1, max_size=12), st.integers(1, 8), st.integers(1, 8))
    def check(texts, gram, more):
        length, around = gram + more, {}
        cutter = X.Cutter(gram, length)
        for start, n, h, _, often, _, d in [(*b, d) for d in texts for b in cutter.blocks(d)]:
            piece = d[start:start + n + length - 1]
            assert (len(cutter.places(piece, h)) > 1) == often
            around.setdefault(h, []).append(piece)
        for h, pieces in around.items():
            starts = [sum(map(len, pieces[:k])) + cutter.places(p, h) for k, p in enumerate(pieces)]
            assert A.anchored_starts(pieces, X.np.concatenate(starts), gram, length).tolist() == A.repeated_starts(pieces, length).tolist()
    check()


def test_passage_common_to_many_texts(spark, monkeypatch):
    """Its anchors are settled as they are: each further cut would give rows to every text again."""
    r = random.Random(9)
    own = lambda n: "".join(r.choice("abcdefgh ijk") for _ in range(n))
    passage, twice = own(440), own(120)
    rows = [(i, own(r.randrange(60)) + passage + own(r.randrange(60))) for i in range(600)]
    rows += [(1000 + i, own(i % 7) + twice + own(150) + twice + own(60)) for i in range(600)] + [(2000, passage[:405]), (2001, passage[30:429])]
    cuts, cut = [], X._cut
    rows += [(3000 + i, own(20) + "Is onhe. " * r.randrange(60, 300) + own(20)) for i in range(80)]       # periodic
    monkeypatch.setattr(X, "ARRAY_BYTES", 40_000)
    monkeypatch.setattr(X, "ANCHORED_BYTES", 80_000, raising=False)
    monkeypatch.setattr(X, "_cut", lambda *a: cuts.append(a[2]) or cut(*a))
    assert result(X.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert cuts == [0]


def shared_words(rows):
    """Words in passages of over 50 words that a document of another id or text has too."""
    rows = [((k, t or ""), (t or "").encode().split()) for k, t in rows]
    where, out = {}, []
    for key, w in rows:
        for i in range(len(w) - 50):
            where.setdefault(tuple(w[i:i + 51]), set()).add(key)
    for key, w in rows:
        hit = {j for i in range(len(w) - 50) if where[tuple(w[i:i + 51])] != {key} for j in range(i, i + 51)}
        out.append((key[0], len(hit)))
    return sorted(out, key=repr)


def test_passages_of_over_50_words(spark, monkeypatch):
    """They are found below the window of 400 bytes too, which removes nothing of them."""
    r = random.Random(10)
    own = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n))
    short, edge, long, twice, hot = own(58), own(50), own(260), own(55), own(70)
    assert len(short) < 400
    rows = [(1, f"{own(90)} {short} {own(40)}"), (2, f"{own(7)} {short}\n"), (3, short.replace(" ", " \n\t")), (4, f"{own(9)} {short[:-9]}"),
            (5, f"{own(30)} {edge} {own(30)}"), (6, edge), (7, f"{own(3)} {long}"), (8, f"{long} {own(80)}"), (9, f"{own(20)} {twice} {own(5)} {twice}"),
            (10, own(300)), (11, "on the " * 200), (12, "on the " * 90 + own(20)), (None, None), (None, ""), (None, own(60)), (13, "é " * 51), (14, "é\f" * 60)]
    rows += [rows[9], rows[9]]                  # one id and text
    rows += [(100 + i, f"{own(i % 9)} {hot} {own(i % 5)}") for i in range(60)]
    for i in range(40):                         # near copies
        t = long.split()
        for _ in range(r.randrange(4)):
            t[r.randrange(260)] = "Z"
        rows.append((200 + i, " ".join(t[r.randrange(100):])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_row(X.remove_repeats(df), "doc_id", "n_shared_words", "n_removed")
    assert sorted([g[:2] for g in got], key=repr) == shared_words(rows)
    found = {g[0]: g[1:] for g in got}
    assert [found[k] for k in (1, 2, 3, 6, 9)] == [(58, 0), (58, 0), (58, 0), (0, 0), (0, 0)] and found[10] == (0, len(rows[9][1]))
    assert result(X.remove_repeats(df)) == brute(rows)
    monkeypatch.setattr(X, "STRETCH", 100)      # of bytes, then of words
    assert by_row(X.remove_repeats(df), "doc_id", "n_shared_words") == shared_words(rows)


def test_odd_rows(odd, none):
    out = X.remove_repeats(odd)
    assert by_row(out, "doc_id") == by_row(odd, "doc_id") and X.remove_repeats(none).count() == 0
    long = next(r for r in out.collect() if r.doc_id == 9)
    assert (long.n_bytes, long.n_removed, len(long.spans), bytes(long.kept)) == (150000, 150000, 1, b"")


def test_query(spark, small):
    got = by_row(QUERIES["op3_suffix_array_dedup"](spark, "/root/testdata/sf0.001"), "doc_id", "n_bytes", "n_removed", "n_spans",
                 "kept_sha256")
    assert got == brute([(r.doc_id, r.text) for r in small.collect()])
