import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import ODD, by_row

from tracewell.llm import fim as M
from tracewell.llm.queries import ORACLE_SQL, QUERIES


def brute(doc_id, text, seed=7, plain=0, spm=50):
    text, digest = text or "", sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


texts = st.lists(st.sampled_from(["a", "\n", "é", "\U0001f600", "<", ">", "P", "S", "M", "<P>", "P>", "<S", " ", "\r\n", "word"]), max_size=14).map("".join)


def test_a_batch_against_brute_force():
    @settings(max_examples=500, deadline=None)
    @given(st.lists(st.one_of(st.none(), texts), max_size=12), st.integers(0, 10**6), st.sampled_from([0, 30, 100]))
    def check(batch, first, plain):
        ids = range(first, first + len(batch))
        digests = [sha256(f"7:{i}".encode()).hexdigest() for i in ids]
        h = [np.array([int(d[8 * k:8 * k + 8], 16) for d in digests], "i8") for k in range(4)]
        data, at = M.buffer(pa.array(batch, pa.string()))
        n, form, _, _, out, out_at = M.rearrange(data, at, h, plain, 50)
        made = M.as_strings(out, out_at).to_pylist()
        assert [(k, M.FORMS[f], o) for k, f, o in zip(n.tolist(), form.tolist(), made)] == [
            (w[0], w[1], w[4]) for w in (brute(i, t, plain=plain) for i, t in zip(ids, batch))]
        assert M.as_strings(*M.restore_all(out, out_at, form)).to_pylist() == [t or "" for t in batch]
    check()


def test_sentinels_over_the_border_of_two_texts():
    batch = pa.array(["a\n<", "P>b\nc", "<", "S>"])
    data, at = M.buffer(batch)
    h = [np.full(4, x) for x in (1, 2, 0, 0)]
    n, form, _, _, out, out_at = M.rearrange(data, at, h, 0, 0)
    assert (form == M.PSM).all() and M.as_strings(*M.restore_all(out, out_at, form)).equals(batch)
    form[1] = M.PLAIN       # a text that stands as it is, after one that ends in a bracket
    outs = pa.array(["<P><S><M>a\n<", "P>b\nc", "<P><S><M><", "S>"])
    assert M.as_strings(*M.restore_all(*M.buffer(outs), np.array([1, 0, 1, 0]))).equals(batch)


def test_slices_of_an_array():
    whole = pa.array(["x", "é\n", None, "b\nc"])
    data, at = M.buffer(whole.slice(1, 3))
    assert bytes(data) == "é\nb\nc".encode() and at.tolist() == [0, 3, 3, 6]


@pytest.mark.parametrize("plain, spm", [(0, 50), (40, 100), (100, 0)])
def test_odd_rows(odd, none, plain, spm):
    made = M.transform(odd, plain_percent=plain, spm_percent=spm)
    assert made.columns == [*odd.columns, "fim"] and M.transform(none).count() == 0
    got = by_row(made.select("doc_id", "fim.*"), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert got == sorted(((r[0], *brute(*r[:2], plain=plain, spm=spm)) for r in ODD), key=repr)
    back = M.restore(made.select("doc_id", "text", "fim.output", "fim.form"))
    assert all(r.restored.text == (r.text or "") for r in back.collect())


def test_query_equals_sql_and_brute_force(spark, small):
    from check_oracle import canon, connect
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op13_fill_in_middle"](spark, sf)
    got = rows.collect()
    want = connect(sf).execute(ORACLE_SQL["op13_fill_in_middle"])
    assert canon([tuple(r) for r in got], rows.columns) == canon(want.fetchall(), [d[0] for d in want.description])
    text = {r.doc_id: r.text for r in small.collect()}
    for r in got:
        n, form, p, m, out = brute(r.doc_id, text[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, p, m, sha256(out.encode()).hexdigest())
        assert r.restored_sha256 == sha256((text[r.doc_id] or "").encode()).hexdigest()
