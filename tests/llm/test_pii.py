import re
from hashlib import sha256

import pytest
from llm_rows import ODD, by_row
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import pii
from tracewell.llm.queries import QUERIES

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) \
                    or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, *m.span(), True))
    return out


def test_base_spans():
    parts = st.sampled_from(["1", "25", "256", "4111 1111 1111 1111", "a", ".", "@", "-", " ", "+", "(", ")", "x.y", "0", "é"])

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(parts, max_size=25).map("".join))
    def check(text):
        found = pii.find(text)
        assert [s for s in found if s[3]] == brute(text)
        for kind in pii.KINDS:
            own = [s[1:] for s in found if s[0] == kind]
            base = [s for s in own if s[2]]
            assert all(a[1] <= b[0] for a, b in zip(base, base[1:]))
            # An added span may reach over others, but lies within none.
            assert not any(x[0] <= a[0] and a[1] <= x[1] for a in own if not a[2] for x in own if x is not a)
    check()


@pytest.mark.parametrize("text, kind, what", [
    ("write to john [at] mail dot example (dot) com now", "email", "john [at] mail dot example (dot) com"),
    ("ask john at mail dot example dot com", "email", "john at mail dot example dot com"),
    ("j\u043ehn@m\u0430il.com!", "email", "j\u043ehn@m\u0430il.com"),
    ("call plus one two one two five five five one two three four ok", "phone",
     "plus one two one two five five five one two three four"),
    ("four one one one one one one one one one one one one one one one", "card",
     "four one one one one one one one one one one one one one one one"),
    ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("\uff11\uff19\uff12.168.1.1 up", "ip", "\uff11\uff19\uff12.168.1.1"),
    ("4111\u200b1111 1111\u00ad1111", "card", "4111\u200b1111 1111\u00ad1111"),
    ("ask john at mail\tdot\texample dot com", "email", "john at mail\tdot\texample dot com"),
    ("host \ua621\ua629\ua622.168.1.1", "ip", "\ua621\ua629\ua622.168.1.1"),      # digits of the Vai script
    ("call plus one four one five five five five two six seven one, 24 hours a day", "phone",
     "plus one four one five five five five two six seven one"),
    ("+1 415 five five five two six seven one, 9am to 5pm", "phone", "+1 415 five five five two six seven one"),
    ("+1 four one five five five five 2671", "phone", "+1 four one five five five five 2671"),
    ("four one one one one one one one one one one one one one one one - 12/29", "card",
     "four one one one one one one one one one one one one one one one"),
    ("four one one one one one one one one one one one one one one one 12/29", "card",
     "four one one one one one one one one one one one one one one one"),
    ("20 four one one one one one one one one one one one one one one one", "card",
     "four one one one one one one one one one one one one one one one"),
    ("four one one one one one one one one one one one one one one one. 20 more", "card",
     "four one one one one one one one one one one one one one one one"),
    ("ip one nine two dot 168 dot zero dot one", "ip", "one nine two dot 168 dot zero dot one"),
])
def test_disguises(text, kind, what):
    found = [s for s in pii.find(text) if not s[3]]
    assert [(k, text[a:b]) for k, a, b, _ in found] == [(kind, what)]
    assert pii.redact(text, found) == text.replace(what, f"[{kind.upper()}]")


@pytest.mark.parametrize("text, base", [
    ("\u0430lice@example.com", "lice@example.com"), ("john.d\u043ee@example.com", "e@example.com"),
    ("john [dot] smith@example.com", "smith@example.com"), ("alice@example.c\u043em", "alice@example.c")])
def test_disguise_around_a_base_match(text, base):
    found = pii.find(f"to {text}, now")
    assert sorted((f"to {text}, now"[a:b], plain) for _, a, b, plain in found) == sorted([(text, False), (base, True)])
    assert pii.redact(f"to {text}, now", found) == "to [EMAIL], now"


@pytest.mark.parametrize("text", [
    "we met at the house and it was one of those days", "one two three", "look at dot com prices", "le 5º jour à 3 h",
    "[1] see (2) and {3}", "Она пришла в 5 часов"])
def test_clean_text_is_left_alone(text):
    assert pii.find(text) == [] and pii.redact(text, []) == text


def test_overlaps_are_redacted_once():
    text = "x +1 234.555.123.45 y"
    assert pii.redact(text, pii.find(text)).count("[") == 1


def test_linear_time():
    for text in ("1" * 200000, "1.1." * 50000, "a" * 200000 + "@", "+1 " + "(" * 100000, "one " * 50000, "at dot " * 30000):
        pii.find(text)


def test_rows(odd, none):
    rows = pii.spans(odd, name="out").collect()
    assert len(rows) == len(ODD) and all([tuple(s) for s in r.out.spans if s.base] == brute(r.text) for r in rows)
    clean = pii.redacted(odd)
    assert clean.columns == odd.columns and by_row(clean, "doc_id", "text") == by_row(odd, "doc_id", "text")
    assert pii.spans(none, name="out").count() == 0 and pii.redacted(none).count() == 0


def test_query(spark, small):
    got = by_row(QUERIES["op2_pii_transducers"](spark, "/root/testdata/sf0.001"), "doc_id", "n_email", "n_ip", "n_card", "n_phone",
                 "base_sha256")
    want = []
    for r in small.collect():
        spans = brute(r.text)
        want.append((r.doc_id, *[sum(s[0] == k for s in spans) for k in pii.KINDS],
                     sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
