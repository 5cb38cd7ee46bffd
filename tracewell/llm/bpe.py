"""Byte-level BPE by monoid tree reduction.

Encodings of byte strings form a monoid under "concatenate and re-encode", so a
piece is encoded as a tree: both halves recursively, then their join. A join only
re-encodes a window of tokens around the boundary. It relies on one fact: a token
sequence is the encoding of its bytes exactly if each two neighbours are the
encoding of their own bytes. (Take the first merge that would cross a boundary of
the sequence. Until then each token was built as if alone, so the same merge would
come up when its two neighbours are encoded by themselves.) Left of the window and
right of it neighbours are unchanged, so only the two seams need a look; while a
seam fails, the window grows by twice as many tokens on that side.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewell.llm.common import annotate, per_worker, texts

#: Bytes that are merged directly, without halving.
LEAF = 8
#: Strings of up to this many bytes are merged by scanning, longer ones with a heap.
SCANNED = 48
#: Distinct pieces, short strings and token pairs whose result a worker remembers: the
#: newest so many and at least those used since as many others came.
REMEMBERED = 150_000
#: Longer pieces are not remembered.
LONGEST_KEPT = 64
NO_RANK = 1 << 62
#: Characters of a text that are cut into pieces at once.
STRETCH = 1 << 20

FIELDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
                       T.StructField("decoded", T.BinaryType(), False)])


class Recent(dict):
    """Dictionary of bounded size: two generations, the older one dropped when the newer is full."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def add(self, key, value):
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def look(self, key):
        """For keys that ``get`` did not find."""
        value = self.older.get(key)
        return value if value is None else self.add(key, value)


def classes(pattern: str, top: int) -> str:
    r"""``pattern`` with ``\\s``, ``\\S``, ``\\p{L}`` and ``\\p{N}`` spelled out as ranges for ``re``.

    The ranges end at the character ``top``, for texts without later ones. ``re``
    looks ranges up in a bitmap, which is faster than property tests, and its own
    white space differs from the Unicode property.
    """
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    ranges = {"L": [], "N": []}
    for kind, found in ranges.items():
        for c in range(top + 1):
            if unicodedata.category(chr(c))[0] == kind:
                if found and found[-1][1] == c - 1:
                    found[-1][1] = c
                else:
                    found.append([c, c])
    spelled = {r"\p{%s}" % k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in ranges.items()} | {r"\s": space}

    def swap(m: re.Match) -> str:
        if m[0] == r"\S":
            return f"[^{space}]"
        before = pattern[:m.start()]
        return spelled[m[0]] if before.rfind("[") > before.rfind("]") else f"[{spelled[m[0]]}]"

    return re.sub(r"\\s|\\S|\\p\{[LN]\}", swap, pattern)


class Codec:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.sizes = np.array([len(t) for t in self.tokens], "i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(self.tokens), "u1")
        self.latin, self.wide = (re.compile(classes(pattern, top)) for top in (0xFF, sys.maxunicode))
        self.pairs, self.short, self.pieces = Recent(), Recent(), Recent()

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}, pattern)

    # ---- encoding

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, then leftmost: the definition, for leaves and windows."""
        one = self.ranks.get(data)
        if one is not None:
            return [one]
        if len(data) > SCANNED:
            return self._merge_long(data)
        out = self.short.get(data) or self.short.look(data)
        if out is None:
            get, parts = self.ranks.get, [data[i:i + 1] for i in range(len(data))]
            found = [get(data[i:i + 2], NO_RANK) for i in range(len(data) - 1)]
            while found and (low := min(found)) != NO_RANK:
                i = found.index(low)
                parts[i] += parts[i + 1]
                del parts[i + 1], found[i]
                if i < len(found):
                    found[i] = get(parts[i] + parts[i + 1], NO_RANK)
                if i:
                    found[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
            out = self.short.add(data, [self.ranks[p] for p in parts])
        return out

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of candidate merges over a linked list."""
        n, get = len(data), self.ranks.get
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = nxt[i] if end[i] else n
            if j >= n or end[j] != to:
                continue        # one side has changed since
            end[i], nxt[i], end[j] = to, nxt[j], 0
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := get(data[i:end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prv[i]) >= 0 and (r := get(data[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i:end[i]]])
            i = nxt[i]
        return out

    def neighbours(self, a: int, b: int) -> bool:
        """Whether ``a, b`` is the encoding of its bytes."""
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.pairs.look(key)
            if ok is None:
                ok = self.pairs.add(key, self.merge(self.tokens[a] + self.tokens[b]) == [a, b])
        return ok

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two encoded strings put together."""
        if self.neighbours(left[-1], right[0]):
            return left + right
        tokens, i, j, grow_l, grow_r = self.tokens, len(left) - 1, 1, 1, 1
        while True:
            window = self.merge(b"".join([tokens[t] for t in left[i:] + right[:j]]))
            ok_l = i == 0 or self.neighbours(left[i - 1], window[0])
            ok_r = j == len(right) or self.neighbours(window[-1], right[j])
            if ok_l and ok_r:
                return left[:i] + window + right[j:]
            if not ok_l:
                i, grow_l = max(0, i - grow_l), 2 * grow_l
            if not ok_r:
                j, grow_r = min(len(right), j + grow_r), 2 * grow_r

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, text: str) -> bytes:
        """Ids of one piece as little-endian 32-bit numbers."""
        out = self.pieces.look(text)
        if out is None:
            data = text.encode()
            one = self.ranks.get(data)
            ids = self.tree(data) if one is None else (one,)
            out = struct.pack(f"<{len(ids)}i", *ids)
            if len(text) <= LONGEST_KEPT:
                self.pieces.add(text, out)
        return out

    def _stretches(self, text: str) -> Iterator[list[str]]:
        try:
            text.encode("latin-1")
            pattern = self.latin
        except UnicodeEncodeError:
            pattern = self.wide
        if len(text) <= STRETCH:
            yield pattern.findall(text)
            return
        held, size = [], 0
        for m in pattern.finditer(text):
            held.append(m[0])
            size += len(m[0])
            if size >= STRETCH:
                yield held
                held, size = [], 0
        yield held

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text: its pieces are encoded apart, so they only concatenate."""
        known, piece = self.pieces.get, self.piece
        parts = [b"".join([known(p) or piece(p) for p in ps]) for ps in self._stretches(text)]
        return np.frombuffer(b"".join(parts), "<i4")

    # ---- decoding

    def _letters_of(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.letters[np.repeat(shift, sizes) + np.arange(sizes.sum())].tobytes()

    def decode(self, ids: np.ndarray, leaf: int = 1 << 16) -> bytes:
        """Bytes of the tokens: leaves of so many ids, concatenated up a binary tree."""
        parts = [self._letters_of(ids[k:k + leaf]) for k in range(0, len(ids), leaf)]
        while len(parts) > 1:
            parts = [b"".join(parts[k:k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def encode_decode(df: DataFrame, text: str, ranks_path: str, pattern: str, *, name: str = "bpe",
                  keep: list[str] | None = None) -> DataFrame:
    """``df`` with a struct ``name``: ``ids`` of the whole text and the bytes ``decoded`` from them.

    Null and empty text give no ids and no bytes. Rows stand alone: repeated rows
    and ties do not matter, an empty table stays empty, and other columns of any
    name pass through. A text may be of any length; it is cut into pieces by
    stretches, and a piece of any length is encoded in n log^2 n steps at most.
    """

    def make():
        codec = per_worker(("bpe", ranks_path, pattern), lambda: Codec.load(ranks_path, pattern))

        def work(col: pa.Array) -> tuple[pa.Array, ...]:
            ids = [codec.encode(t) for t in texts(col)]
            ends = np.cumsum([0, *map(len, ids)]).astype("i4")
            flat = pa.array(np.concatenate(ids) if ids else np.array([], "i4"), pa.int32())
            return pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([codec.decode(i) for i in ids], pa.binary())

        return work

    return annotate(df, [text], FIELDS, make, name, keep)
