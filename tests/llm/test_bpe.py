import random
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from llm_rows import ODD, by_row
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import bpe
from tracewell.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_matches_the_library(codec, tik):
    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(), st.text("ab "), st.text("then ig"), st.text("é=-\n "), st.text("0123456789'st")))
    def check(text):
        ids = codec.encode(text)
        assert ids.tolist() == tik.encode_ordinary(text)
        assert codec.decode(ids, 3) == text.encode()
    check()


def test_every_character(codec, tik):
    for c in [*range(0x3000), *range(0x1D400, 0x1D800), *range(0xE000, 0x10FFFF, 997)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1{chr(c)}{chr(c)} ."
            assert codec.encode(text).tolist() == tik.encode_ordinary(text)


def test_long_pieces(codec, tik):
    r = random.Random(4)
    for text in ("a" * 3000, "ab" * 1500, " " * 5000, "".join(r.choice("the ing") for _ in range(4000)).replace(" ", "")):
        assert codec.encode(text).tolist() == tik.encode_ordinary(text)


def test_stretches_and_eviction(codec, tik, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    own = bpe.Codec(codec.ranks, public_tokenizers.PATTERN)
    text = " ".join(f"word{i % 37} and déjà {i}" for i in range(300))
    assert own.encode(text).tolist() == tik.encode_ordinary(text)


def test_rows(odd, none, tik):
    out = bpe.encode_decode(odd, "text", PATH, public_tokenizers.PATTERN, name="out")
    assert out.columns == [*odd.columns, "out"]
    got = [(r.doc_id, r.text, r.out.ids, bytes(r.out.decoded)) for r in out.collect()]
    want = [(d[0], d[1], tik.encode_ordinary(d[1] or ""), (d[1] or "").encode()) for d in ODD]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.encode_decode(none, "text", PATH, public_tokenizers.PATTERN, name="out").count() == 0


def test_query(spark, small, tik):
    got = by_row(QUERIES["op8_byte_bpe"](spark, "/root/testdata/sf0.001"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for r in small.collect():
        ids = tik.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(r.text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
