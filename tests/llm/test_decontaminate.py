import re
from hashlib import sha256

from llm_rows import ODD, PROSE, by_row

from tracewell.llm import decontaminate as D
from tracewell.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items):
    """(number of words, covered words, ids), window by window."""
    words, hit, ids = WORD.findall(fold(text)), set(), set()
    for item, data in items:
        own = WORD.findall(fold(data))
        for k in range(max(1, len(own) - 9)) if own else ():
            w = own[k:k + 10]
            for at in range(len(words) - len(w) + 1):
                if words[at:at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
                    ids |= {str(item)} if item is not None else set()
    return len(words), hit, sorted(ids)


ITEMS = [(1, PROSE[:90]), (2, "lazy dog"), (2, "lazy dog"), (3, None), (4, "!?"), (None, "bronze puzzles"), (10, "LAZY, dog"),
         (5, "line 3 of a long text number 9"), (6, "中文")]


def test_rows(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = []
    for d in ODD:
        n, hit, ids = brute(d[1], ITEMS)
        want.append((d[0], d[1], n, len(hit), ids))
    for part_bytes in (1 << 20, 40):
        out = D.scan(odd, items, name="out", part_bytes=part_bytes)
        assert out.columns == [*odd.columns, "out"]
        rows = out.collect()
        got = [(r.doc_id, r.text, r.out.n_words, sum(s.last_word - s.first_word + 1 for s in r.out.spans), r.out["items"])
               for r in rows]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        for r in rows:
            for s in r.out.spans:
                assert len(WORD.findall(r.text[s.start:s.end])) == s.last_word - s.first_word + 1
                assert WORD.match(fold(r.text[s.start])) and WORD.match(fold(r.text[s.end - 1]))
    assert D.scan(none, items, name="out").count() == 0
    assert D.scan(odd, items.limit(0), name="out").filter("size(out.spans) > 0").count() == 0


def test_query(spark, small):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    windows = {}
    for item, text in items:
        w = WORD.findall(fold(text))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(item))
    want = []
    for r in small.collect():
        words, hit, ids = WORD.findall(fold(r.text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                own = windows.get(tuple(words[k:k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    ids |= own
        want.append((r.doc_id, len(words), len(hit), len(ids), sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    got = by_row(QUERIES["op7_benchmark_automaton"](spark, "/root/testdata/sf0.001"), "doc_id", "n_words", "n_hit", "n_items",
                 "items_sha256", "contaminated")
    assert got == sorted(want, key=repr) and any(w[-1] for w in want)
