"""Quality rules on repetition coverage.

Each word becomes a 64-bit number, and rolling hashes of several n-gram lengths are
grown from one another in numpy: the hash for n words is the one for n - 1 times a
constant plus the next word. What counts is the share of characters that lie inside
n-grams found twice or more, and inside lines equal to an earlier line.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewell.llm.common import annotate, fresh, raw

#: Largest share of word characters inside repeated n-grams, by n.
MAX_COVERED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters in lines equal to an earlier one.
MAX_LINE_CHARS = 0.20
MIN_WORDS = 10
#: Words in repeated windows of five, percent.
MAX_REPEATED = 20
BASE_N = 5

SYMBOLS = b"#*$%&|<>"
BLANKS = b"\t\n\x0b\x0c\r "
_STEP = np.uint64(0x9E3779B97F4A7C15)

FIELDS = T.StructType([
    *[T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                                                      "n_repeat_words")],
    T.StructField("covered", T.ArrayType(T.DoubleType(), False), False),
    T.StructField("dup_line_chars", T.DoubleType(), False),
    T.StructField("base_failed", T.BooleanType(), False),
    T.StructField("kept", T.BooleanType(), False)])


def chars(data: bytes) -> int:
    """Code points of ``data`` that are not white space."""
    body = data.translate(None, BLANKS)
    return len(body) if body.isascii() else int(np.count_nonzero((np.frombuffer(body, "u1") & 0xC0) != 0x80))


def covered_words(grams: np.ndarray, n: int) -> np.ndarray | None:
    """Mask of the words inside n-grams that occur twice or more; None if there are none."""
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return None
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(grams) + n, "i4")
    edge[:len(grams)] += twice
    edge[n:] -= twice
    return np.cumsum(edge[:-1]) > 0


def measure(data: bytes) -> tuple:
    """All fields for one text."""
    words = data.split()
    n, total = len(words), chars(data)
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))

    lines = [x for x in data.split(b"\n") if x.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    dup_chars, seen = 0, set()
    if n_dup_lines:
        for x in lines:
            if x in seen:
                dup_chars += chars(x)
            seen.add(x)

    repeated, covered = 0, dict.fromkeys(MAX_COVERED, 0.0)
    if n > BASE_N:
        h = np.fromiter(map(hash, words), "i8", n).view("u8")
        grams, lengths = h, None
        for k in range(2, max(MAX_COVERED) + 1):
            if len(grams) < 2:
                break
            grams = grams[:-1] * _STEP + h[k - 1:]
            if k not in covered and k != BASE_N:
                continue
            mask = covered_words(grams, k)
            if mask is None:
                break       # longer n-grams cannot repeat either
            if k == BASE_N:
                repeated = int(mask.sum())
            if lengths is None:
                lengths = np.fromiter(map(len, words), "i8", n) if data.isascii() else np.fromiter(map(chars, words), "i8", n)
            covered[k] = float(lengths[mask].sum()) / total
    line_share = dup_chars / total if total else 0.0
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    kept = not base_failed and all(covered[k] <= most for k, most in MAX_COVERED.items()) \
        and line_share <= MAX_LINE_CHARS
    return (n, total, n_symbols, len(lines), n_dup_lines, repeated, list(covered.values()), line_share, base_failed, kept)


def assess(docs: DataFrame, text: str = "text", *, name: str = "rules", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct ``name`` of the measures and the verdict ``kept``.

    Words are what stands between blanks, tabs, line and form feeds and carriage
    returns; lines without a word do not count. ``covered`` has the share of word
    characters inside repeated n-grams for the lengths of :data:`MAX_COVERED`. A text
    fails at once (``base_failed``) with fewer than ten words or over a fifth of its
    words in repeated windows of five, else if a share is above its bound.

    Null and empty texts have no words, so they are not kept. Rows stand alone:
    repeated rows get the same verdict, an empty table stays empty, and other columns
    of any name pass through. Work is linear in the text, but for the sort of hashes.
    """
    return annotate(docs, [text], FIELDS, lambda: lambda col: [measure(b) for b in raw(col)], name, keep)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with their own columns."""
    name = fresh(docs, "rules")
    return assess(docs, text, name=name).filter(f"{name}.kept").drop(name)

