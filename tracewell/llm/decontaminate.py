"""Benchmark decontamination with an Aho-Corasick automaton.

Test items and documents are normalised to lower-case words between single blanks.
Every window of ten consecutive item words (a shorter item is one window) becomes a
pattern of the automaton, with a blank at both ends, so a text is scanned once for
all of them. A match ends at a blank, whose ordinal number is the word's number; the
original position of each word is known from its bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import annotate, fresh, per_worker, raw, stored

WINDOW = 10
#: Item bytes put into one automaton; a larger set takes more passes, one after the other
#: over the whole table. A megabyte makes some eight million nodes, which were measured at 443 MB
#: of a worker's memory: every word begins a pattern of ten.
PART_BYTES = 1 << 20

#: Letters to lower case, every other ASCII character but digits to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = np.array([c != 32 for c in FOLD])

SPAN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("first_word", "last_word", "start", "end")])
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("spans", T.ArrayType(SPAN, False), False),
    T.StructField("items", T.ArrayType(T.StringType(), False), False)])


def normalise(data: bytes) -> bytes:
    """Words of ``data`` with one blank before, between and behind; a single blank if there are none."""
    words = data.translate(FOLD).split(b" ")
    return b" ".join([b"", *filter(None, words), b""]) if any(words) else b" "


def windows(norm: bytes) -> list[bytes]:
    """Patterns of one normalised item."""
    words = norm.split()
    return [b" " + b" ".join(words[k:k + WINDOW]) + b" " for k in range(max(1, len(words) - WINDOW + 1))] if words else []


def automaton(items: list[tuple[str | None, bytes]]):
    """Automaton from (item id, text) pairs; the value of a pattern is (its words, its item ids)."""
    import ahocorasick
    owners: dict[bytes, set] = {}
    for item, data in items:
        for w in windows(normalise(data)):
            owners.setdefault(w, set()).add(item)
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word(w.decode("latin-1"), (w.count(b" ") - 1, ids))
    if owners:
        found.make_automaton()
    return found


def matches(found, norm: bytes) -> tuple[list[tuple[int, int]], set]:
    """Disjoint word ranges ``[first, end)`` covered by patterns in a normalised text, and the item ids."""
    hits = list(found.iter(norm.decode("latin-1"))) if len(found) else []
    if not hits:
        return [], set()
    blanks = np.cumsum(np.frombuffer(norm, "u1") == 32)
    ids, ranges = set(), []
    for at, (n, owners) in hits:
        ids |= owners
        end = int(blanks[at]) - 1       # words before this blank
        ranges.append((end - n, end))
    return join_ranges(ranges), ids


def join_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Character positions of the words' beginnings and ends in the original text."""
    b = np.frombuffer(data, "u1")
    word = np.concatenate([[False], _WORD[b], [False]])
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return chars[edge[::2]], chars[edge[1::2]]


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
         name: str = "leak", keep: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with a struct ``name``: ``n_words``, ``spans`` covered by item windows and the ``items`` they come from.

    A span gives its first and last word (counted from 0) and its character range in
    the original text; spans are disjoint and maximal, ids are distinct and sorted as
    strings. The item texts are read in parts of at most about ``part_bytes``, about half
    a gigabyte of a worker's memory each; what one pass has found is written before the next, or
    all their automata would be in memory at once. A single larger item still goes whole. Documents
    are not shuffled.

    Null and empty texts have no words and no spans, an item without words matches
    nothing, repeated items count once, and an item with a null id covers words but
    adds no id. Empty tables give empty or clean results; other columns pass through.
    """
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).cast("binary").alias("data"))
    total = items.agg(F.sum(F.length("data"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    columns = list(docs.columns if keep is None else keep)
    out = docs.select(*dict.fromkeys([*columns, text]))
    state = None
    for k in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("id", "data"), F.lit(parts)) == k)
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own.distinct().collect()])
        last = k == parts - 1
        made = name if last else fresh(out, f"part_{k}")
        out = _pass(out, text, state, shared, made, columns if last else [*out.columns] if state is None else
                    [c for c in out.columns if c != state])
        state = made
        if not last:
            out = stored(out)
    return out


def _pass(df: DataFrame, text: str, state: str | None, shared, name: str, keep: list[str]) -> DataFrame:
    """Scan for one part of the items and add what the parts before, in column ``state``, have found."""

    token = uuid.uuid4().hex

    def make():
        found = per_worker(("aho", token), lambda: automaton([(i, bytes(d or b"")) for i, d in shared.value]))

        def work(col: pa.Array, before: pa.Array | None = None) -> list[tuple]:
            out = []
            for data, old in zip(raw(col), before.to_pylist() if before is not None else iter(lambda: None, 0), strict=False):
                norm = normalise(data)
                ranges, ids = matches(found, norm)
                ids = {i for i in ids if i is not None}
                if old:
                    ranges = join_ranges(ranges + [(s["first_word"], s["last_word"] + 1) for s in old["spans"]])
                    ids |= set(old["items"])
                spans = []
                if ranges:
                    starts, ends = offsets(data)
                    spans = [{"first_word": a, "last_word": b - 1, "start": int(starts[a]), "end": int(ends[b - 1])}
                             for a, b in ranges]
                out.append((norm.count(b" ") - 1, spans, sorted(ids)))
            return out

        return work

    return annotate(df, [text] if state is None else [text, state], FIELDS, make, name, keep)
