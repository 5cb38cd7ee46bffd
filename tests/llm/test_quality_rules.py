import re
from collections import Counter

from llm_rows import ODD, PROSE, by_row

from tracewell.llm import quality_rules as Q
from tracewell.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def repeated(n):
        count = Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1))
        return {j for k in range(len(words) - n + 1) if count[tuple(words[k:k + n])] > 1 for j in range(k, k + n)}

    chars = sum(map(len, words))
    covered = [sum(len(words[k]) for k in repeated(n)) / chars if chars else 0.0 for n in Q.MAX_COVERED]
    five = len(repeated(5))
    failed = len(words) < 10 or 100 * five > 20 * len(words)
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), five, failed), covered


def same(got, want):
    return got[0] == want[0] and all(abs(a - b) < 1e-12 for a, b in zip(got[1], want[1], strict=True))


def test_rows(odd, none):
    rows = Q.assess(odd, name="out").collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert len(rows) == len(ODD)
    for r in rows:
        assert same((tuple(r.out[f] for f in fields), r.out.covered), brute(r.text))
        assert not (r.out.base_failed and r.out.kept)
    assert Q.assess(none, name="out").count() == 0
    kept = Q.keep_good(odd)
    assert kept.columns == odd.columns
    assert by_row(kept, "doc_id") == sorted([(5,), (5,), (6,), (7,), (None,)], key=repr)


def test_verdict_of_the_method():
    body = " ".join(f"w{i}" for i in range(300))
    assert Q.measure(body.encode())[-1] and Q.measure(PROSE.encode())[-1]
    copied = " ".join(f"c{i}" for i in range(28))
    twice = Q.measure(f"{body} {copied} between {copied}".encode())
    assert not twice[-2] and not twice[-1]          # 16 % of the words, below the base limit, above that of the method
    lines = "\n".join([body] + ["many short words here a b c d e f g h"] * 2)
    assert Q.measure(lines.encode())[-1]


def test_query(spark, small):
    got = QUERIES["op4_repetition_rules"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in small.collect()}
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[0]
