"""Removal of every byte inside a long string that occurs twice or more.

Each window of ``LENGTH`` bytes has an anchor: the smallest hash among its grams of
``grams[0]`` bytes. Equal windows have equal anchors, and consecutive windows mostly
share theirs, so a text falls into blocks of windows with one anchor, about one for
150 bytes. Blocks are told apart by (anchor, hash of their bytes), and only those two
numbers move at first. An anchor met in one block only, once, cannot hold a repeat.
Blocks equal throughout repeat as a whole. What is left, different blocks around one
anchor, is settled by suffix arrays over one copy of each block, small anchors packed
together into one array. A crowded anchor, as of a passage common to many texts, is settled
by the suffixes that start at it and, read backwards, end at it: two for a block, or few for a periodic one. One with
too many blocks for one task even so is cut again around longer grams, in the end as long as
the window itself: all windows of such an anchor are one string, so they are settled by their
number.

Passages are often shorter than that window. Those of ``PASSAGE`` words that another document
has too are counted beside, removed or not, by the same anchors and blocks over words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import annotate, checkpointed, fresh, raw
from tracewell.llm.suffix_array import anchored_starts, repeated_starts

LENGTH = 400
#: Gram lengths of the anchors: the first for all texts, the next ones for crowded anchors.
GRAMS = (100, 250, 330, 370, 390, LENGTH)
#: Bytes of different blocks in one suffix array, about; an anchor with more than twice as many is crowded.
ARRAY_BYTES = 256 << 10
#: Bytes of blocks from which a crowded anchor is settled by the suffixes at it (fewer are crowded only with small arrays), and
#: the most memory that may take in one task, about. Other crowded anchors are cut again.
ANCHORED_BYTES, ANCHORED_MEMORY = 2 * ARRAY_BYTES, 48 << 20
#: Suffix arrays that one task sorts, about, where there are more of them than shuffle partitions.
ARRAYS_A_TASK = 16
#: Windows of a text that are hashed at once.
STRETCH = 1 << 20
#: Words of the shortest passage that counts as shared, and of the grams of its anchors.
PASSAGE, WORD_GRAM = 51, 8

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)

_BLOCK = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("n", T.LongType(), False),
                       T.StructField("h", T.LongType(), False), T.StructField("c", T.LongType(), False),
                       T.StructField("often", T.BooleanType(), False), T.StructField("memory", T.LongType(), False)])
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_WORD_BLOCK = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "n", "h", "c")])
_WORD_WINDOW = T.StructType([T.StructField(c, T.LongType(), False) for c in ("h", "w", "start")] + [T.StructField("whole", T.BooleanType(), False)])
RANGES = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


class Cutter:
    """Cuts texts into blocks of windows with one anchor."""

    def __init__(self, gram: int, length: int = LENGTH):
        self.gram, self.length, self.across = gram, length, length - gram + 1
        m = STRETCH + length
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(m, _BASE, "u8")])
            self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(m, pow(_BASE, -1, 1 << 64), "u8")])

    def _grams(self, b: np.ndarray) -> np.ndarray:
        """Mixed polynomial hash of the gram at each place."""
        return self._strings(b, self.gram)

    def _strings(self, b: np.ndarray, size: int) -> np.ndarray:
        total = self._sums(b)
        return self._mixed((total[size:] - total[:-size]) * self.inverse[:len(b) - size + 1])

    def _sums(self, b: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum((b.astype("u8") + np.uint64(1)) * self.power[:len(b)])]

    @staticmethod
    def _mixed(g: np.ndarray) -> np.ndarray:
        g ^= g >> np.uint64(32)
        g *= _MIX
        return g ^ (g >> np.uint64(29))

    def _lowest(self, g: np.ndarray) -> np.ndarray:
        """Smallest of each ``across`` neighbours, from running minima within strips of that width."""
        w, n = self.across, len(g)
        strips = np.pad(g, (0, -n % w), constant_values=np.iinfo("u8").max).reshape(-1, w)
        forward = np.minimum.accumulate(strips, axis=1).ravel()
        backward = np.minimum.accumulate(strips[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(backward[:n - w + 1], forward[w - 1:n])

    def places(self, data: bytes, anchor: int) -> np.ndarray:
        """Starts of all grams with the hash ``anchor``."""
        b, found = np.frombuffer(data, "u1"), [np.zeros(0, "i8")]
        for at in range(0, len(b) - self.gram + 1, STRETCH):
            found.append(at + np.flatnonzero(self._grams(b[at:at + STRETCH + self.gram - 1]).view("i8") == anchor))
        return np.concatenate(found)

    def blocks(self, data: bytes) -> Iterator[tuple[int, int, int, int, bool, int]]:
        """(first window, windows, anchor, hash of the bytes, whether the anchor is in them more than once, bytes to sort the suffixes at it)."""
        import xxhash
        b = np.frombuffer(data, "u1")
        for at in range(0, len(b) - self.length + 1, STRETCH):
            g = self._grams(b[at:at + STRETCH + self.length - 1])
            low = self._lowest(g)
            cut = np.flatnonzero(np.r_[True, low[1:] != low[:-1], True]).tolist()
            anchors = low[cut[:-1]]
            signed = anchors.view("i8").tolist()
            for k, (x, y) in enumerate(zip(cut, cut[1:])):
                places = np.flatnonzero(g[x:y + self.across - 1] == anchors[k]).tolist()
                own = data[at + x:at + y + self.length - 1]
                # Each different string after and before the anchor is held once; in a periodic text these are few.
                kinds = len(places) if len(places) < 3 else len({own[p:p + self.length] for p in places})
                c = xxhash.xxh3_64_intdigest(own)
                yield at + x, y - x, signed[k], c - (1 << 64) if c >> 63 else c, len(places) > 1, 2 * self.length * kinds + 64 * len(places)


class WordCutter(Cutter):
    """The same over the words of many texts at once, each word a number: its hash."""

    def __init__(self):
        super().__init__(WORD_GRAM, PASSAGE)

    @staticmethod
    def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts, and how many each has."""
        import xxhash
        found, sizes = [np.zeros(0, "u8")], np.zeros(len(texts), "i8")
        for k, data in enumerate(texts):
            at = 0
            while at < len(data):
                blank = _BLANK.search(data, at + STRETCH)
                end = blank.end() if blank else len(data)
                found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, data[at:end].split()), "u8"))
                sizes[k] += len(found[-1])
                at = end
        return np.concatenate(found), sizes

    def word_blocks(self, words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Arrays (text, first window, windows, anchor, hash of the words) for each stretch."""
        text, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        for at in range(0, len(words) - self.length + 1, STRETCH):
            b = words[at:at + STRETCH + self.length - 1]
            own = text[at:at + len(b)]
            inside = np.flatnonzero(own[self.length - 1:] == own[:len(b) - self.length + 1])      # not across two texts
            if len(inside):
                low = self._lowest(self._grams(b))[inside]
                cut = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (np.diff(inside) != 1), True])
                x, y = inside[cut[:-1]], inside[cut[1:] - 1] + 1
                total = self._sums(b)
                c = self._mixed((total[y + self.length - 1] - total[x]) * self.inverse[x]) ^ (y - x).astype("u8")
                yield own[x], at + x - first[own[x]], y - x, low[cut[:-1]].view("i8"), c.view("i8")

    def windows(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Hash of each window that starts at ``places``."""
        every = [self._strings(words[at:at + STRETCH + self.length - 1], self.length) for at in range(0, len(words) - self.length + 1, STRETCH)]
        return np.concatenate([np.zeros(0, "u8"), *every])[places].view("i8")


def _cut(df: DataFrame, column: str, level: int, keep: list[str], name: str) -> DataFrame:
    """``keep`` and the fields of a block, a row for each block of the bytes or text in ``column``."""
    gram = GRAMS[level]
    fields = T.StructType([T.StructField("blocks", T.ArrayType(_BLOCK, False), False)])
    kinds = {"start": "i8", "n": "i8", "h": "i8", "c": "i8", "often": "?", "memory": "i8"}

    def make():
        cutter = Cutter(gram)

        def work(col: pa.Array) -> tuple[pa.Array]:
            found, ends = [], [0]
            for data in raw(col):
                found += cutter.blocks(data)
                ends.append(len(found))
            cols = list(zip(*found)) or [()] * len(kinds)
            rows = pa.StructArray.from_arrays([pa.array(np.array(c, k)) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))
            return (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows),)

        return work

    return annotate(df, [column], fields, make, name, keep).select(*keep, F.inline(f"{name}.blocks"))


def _shared(blocks: DataFrame, weight: str | None = None) -> DataFrame:
    """Blocks whose anchor occurs twice or more, with ``mixed``: false where all blocks of the anchor are equal.

    Two blocks stand behind a row of ``weight`` 2 or more. The statistics of an anchor
    are fixed-width; the join back lets adaptive execution split a frequent anchor.
    """
    rows = F.sum(weight) if weight else F.count("*")
    stats = blocks.groupBy("h").agg(rows.alias("rows"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("often").alias("loops"))
    stats = stats.filter("rows > 1 OR loops").select("h", F.expr("c0 <> c1 OR rows = 1").alias("mixed"))
    return blocks.join(stats, "h")


def _settle(pieces: DataFrame, level: int) -> DataFrame:
    """(h, c, ranges): the ranges of windows, counted within the block (h, c), that occur elsewhere too.

    ``pieces`` has a row (h, c, weight, memory, data) for each different block: two blocks of
    one anchor meet in one task unless it has too many even for a crowded one. A block has one
    row at most, with disjoint ranges that do not touch, so a join gives its occurrences a row each.
    """
    sizes = pieces.groupBy("h").agg(F.sum(F.length("data")).alias("bytes"), F.sum("memory").alias("memory"))
    crowd, few = F.col("bytes") > 2 * ARRAY_BYTES, (F.col("bytes") > ANCHORED_BYTES) & (F.col("memory") <= ANCHORED_MEMORY)
    total, crowded, over = sizes.agg(F.sum("bytes"), F.count_if(crowd & few), F.count_if(crowd & ~few)).first()
    arrays = max(1, (total or 0) // ARRAY_BYTES)
    fits = pieces
    if crowded or over:
        fits = pieces.join(sizes.filter(crowd).select("h"), "h", "left_anti")
    # An array is few bytes and much work, so the number of partitions is fixed: adaptive execution would merge them.
    parallel = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(arrays, parallel), arrays // ARRAYS_A_TASK)
    settled = T.StructType([T.StructField("h", T.LongType()), T.StructField("c", T.LongType()), T.StructField("ranges", RANGES)])
    out = fits.withColumn("g", F.pmod(F.xxhash64("h"), F.lit(arrays))).repartition(tasks, "g").groupBy("g").applyInArrow(_ranges, settled)
    if crowded:
        gram, length = GRAMS[level], LENGTH
        around = pieces.join(sizes.filter(crowd & few).select("h"), "h", "left_semi")
        out = out.union(around.repartition(min(crowded, parallel), "h").groupBy("h").applyInArrow(
            lambda table: _anchored(table, gram, length), settled))
    if not over:
        return out
    large = sizes.filter(crowd & ~few).select("h")
    whole = fresh(pieces, "cut")
    inner = _cut(pieces.join(large, "h", "left_semi").withColumnsRenamed({"h": "ph", "c": "pc"}), "data", level + 1,
                 ["ph", "pc", "weight", "data"], whole)
    inner = checkpointed(_shared(inner, "weight"))
    # Around grams as long as the window, different blocks are runs of one string and differ in length only.
    last = GRAMS[level + 1] == LENGTH
    found = (inner if last else inner.filter("NOT mixed")).select(
        F.col("ph").alias("h"), F.col("pc").alias("c"), F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    if not last:
        mixed = inner.filter("mixed")
        first = mixed.groupBy("h", "c").agg(F.sum("weight").alias("weight"), F.min(F.struct("ph", "pc", "start")).alias("of"))
        data = mixed.join(first.select("h", "c", F.col("weight").alias("all"), "of.*"), ["h", "c", "ph", "pc", "start"]).select(
            "h", "c", F.col("all").alias("weight"), "memory", F.expr(f"substring(data, int(start + 1), int(n + {LENGTH - 1}))").alias("data"))
        apart = mixed.select("h", "c", "ph", "pc", "start").join(_settle(data, level + 1), ["h", "c"])
        found = found.union(apart.select("ph", "pc", "start", F.explode("ranges").alias("r")).select(
            "ph", "pc", F.expr("start + r.a"), F.expr("start + r.b")))
    return out.union(_joined(found))


def _lists(sizes: np.ndarray, columns: list[np.ndarray], names: list[str]) -> tuple[pa.Array]:
    """A list of structs for each row, of the given sizes."""
    ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    return (pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c) for c in columns], names)),)


def _elsewhere(*key: str) -> Column:
    """Whether a row's key is met in another document."""
    same = Window.partitionBy(*key)
    return F.min("k1").over(same) != F.max("k1").over(same)


def _word_blocks(keyed: DataFrame) -> DataFrame:
    """(k1, k2, start, n, h, c, whole, compare): blocks of word windows whose anchor another document has too.

    ``whole`` blocks are in another document as they are. Of the others all are to be
    ``compare``d window by window, and of equal whole ones around such an anchor one.
    """
    names = _WORD_BLOCK.names

    def make():
        cutter = WordCutter()

        def work(col: pa.Array) -> tuple[pa.Array]:
            words, sizes = cutter.words(raw(col))
            found = list(zip(*cutter.word_blocks(words, sizes))) or [()] * (1 + len(names))
            text, *columns = [np.concatenate([np.zeros(0, "i8"), *c]) for c in found]
            return _lists(np.bincount(text, minlength=len(sizes)), columns, names)

        return work

    fields = T.StructType([T.StructField("blocks", T.ArrayType(_WORD_BLOCK, False), False)])
    rows = annotate(keyed, ["data"], fields, make, "cut", ["k1", "k2"]).select("k1", "k2", F.inline("cut.blocks"))
    around, equal, place = Window.partitionBy("h"), Window.partitionBy("h", "c"), F.struct("k1", "k2", "start")
    rows = rows.withColumns({"other": _elsewhere("h"), "mixed": F.min("c").over(around) != F.max("c").over(around)}).filter("other").drop("other")
    rows = rows.withColumns({"whole": _elsewhere("h", "c"), "one": place == F.min(place).over(equal)})
    return rows.withColumn("compare", F.expr("mixed AND (one OR NOT whole)")).drop("mixed", "one")


def _word_windows(texts: DataFrame) -> DataFrame:
    """(k1, k2, start, n): of the blocks ``words`` of each text that are not whole, the windows that another document has too."""
    names = _WORD_WINDOW.names

    def make():
        cutter = WordCutter()

        def work(col: pa.Array, blocks: pa.Array) -> tuple[pa.Array]:
            words, sizes = cutter.words(raw(col))
            many = np.diff(blocks.offsets.to_numpy())
            start, n, h, whole = (blocks.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "h", "whole"))
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(np.repeat(np.cumsum(sizes) - sizes, many) + start, n) + each
            columns = [np.repeat(h, n), cutter.windows(words, at), np.repeat(start, n) + each, np.repeat(whole, n)]
            return _lists(np.diff(np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(many)]]), columns, names)

        return work

    fields = T.StructType([T.StructField("windows", T.ArrayType(_WORD_WINDOW, False), False)])
    rows = annotate(texts.filter("words IS NOT NULL"), ["data", "words"], fields, make, "cut", ["k1", "k2"]).select("k1", "k2", F.inline("cut.windows"))
    rows = rows.withColumn("other", _elsewhere("h", "w") | F.max("whole").over(Window.partitionBy("h", "w")))
    return rows.filter("other AND NOT whole").select("k1", "k2", "start", F.lit(1).cast("bigint").alias("n"))


def _covered(ranges: DataFrame) -> DataFrame:
    """(k1, k2, n_shared_words): words in the windows that start in the disjoint ranges (k1, k2, start, n)."""
    end = lambda r: r["start"] + r["n"] + F.lit(PASSAGE - 1)
    none = F.struct(F.lit(0).cast("bigint").alias("reach"), F.lit(0).cast("bigint").alias("words"))
    step = lambda s, r: F.struct(
        end(r).alias("reach"), (s["words"] + end(r) - F.greatest(s["reach"], r["start"])).alias("words"))
    own = ranges.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("own"))
    return own.select("k1", "k2", F.aggregate("own", none, step, lambda s: s["words"]).alias("n_shared_words"))


def _joined(found: DataFrame) -> DataFrame:
    """(h, c, ranges) from disjoint ranges (h, c, a, b), those that touch made one; a block's ranges are as many as its windows at most."""
    ends = found.groupBy("h", "c").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    # Where one range ends and the next begins, the run goes on.
    first, last = F.array_sort(F.array_except("a", "b")), F.array_sort(F.array_except("b", "a"))
    return ends.select("h", "c", F.arrays_zip(first.alias("a"), last.alias("b")).cast(RANGES).alias("ranges"))


def _ranges(table: pa.Table) -> pa.Table:
    """One suffix array over the blocks of a group."""
    pieces = table["data"].to_pylist()
    return _marked(table, pieces, repeated_starts(pieces, LENGTH))


def _anchored(table: pa.Table, gram: int, length: int) -> pa.Table:
    """The blocks of one crowded anchor, by the suffixes at it."""
    pieces, anchor = table["data"].to_pylist(), table["h"][0].as_py()
    at = Cutter(gram, length).places(b"".join(pieces), anchor)
    ends = np.cumsum([len(p) for p in pieces])
    at = at[at + gram <= ends[np.searchsorted(ends, at, "right")]]        # not across two pieces
    return _marked(table, pieces, anchored_starts(pieces, at, gram, length))


def _marked(table: pa.Table, pieces: list[bytes], twice: np.ndarray) -> pa.Table:
    """(h, c, ranges) of the windows marked in the concatenated ``pieces``, all of a block that occurs twice."""
    rows, ranges, ends, at = [], [], [0], 0
    for h, c, weight, data in zip(table["h"].to_pylist(), table["c"].to_pylist(), table["weight"].to_pylist(), pieces, strict=True):
        mask = twice[at:at + len(data)]
        if weight > 1:
            mask = np.arange(len(data)) <= len(data) - LENGTH
        at += len(data)
        edge = np.flatnonzero(np.diff(np.r_[0, mask.astype("i1"), 0]))
        if len(edge):
            rows.append((h, c))
            ranges.append(edge.reshape(-1, 2))
            ends.append(ends[-1] + len(edge) // 2)
    h, c = zip(*rows) if rows else ((), ())
    a, b = np.concatenate(ranges).T if ranges else (np.zeros(0, "i8"),) * 2
    pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])
    return pa.table({"h": pa.array(h, pa.int64()), "c": pa.array(c, pa.int64()),
                     "ranges": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)})


# ---- texts --------------------------------------------------------------------------

SPAN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
FIELDS = T.StructType([T.StructField("n_removed", T.LongType(), False), T.StructField("spans", T.ArrayType(SPAN, False), False),
                       T.StructField("kept", T.BinaryType(), False)])


def cut_out(data: bytes, windows: list[tuple[int, int]]) -> tuple[int, list[dict], bytes]:
    """Remove the bytes of all windows that start in the ranges ``windows``."""
    spans: list[list[int]] = []
    for a, b in sorted(windows):
        end = b + LENGTH - 1
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([a, end])
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, kept_sha256, n_shared_words) for every row of ``docs``.

    A byte goes if a string of :data:`LENGTH` bytes over it starts anywhere else too,
    in any row, the same included; overlaps count and strings are judged on the input.
    ``spans`` are the maximal removed runs in bytes; ``kept`` is what remains, null
    where nothing was removed. ``n_shared_words`` counts the words, parted by blanks, in
    passages of :data:`PASSAGE` words or more that a document of another id or text has
    too, whatever their bytes and the blanks between; nothing is removed for them.

    Null texts are empty, texts shorter than the window are never touched. Repeated
    rows (equal id and text) are copies of each other like any two equal texts, and
    each gives a row. Null ids are ids like others. A long text is cut in stretches.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    keyed = keyed.withColumns({"k1": F.xxhash64("doc_id", "data"), "k2": F.xxhash64("data", F.lit(7), "doc_id")})
    blocks = checkpointed(_cut(keyed, "data", 0, ["k1", "k2"], "cut"))
    shared = checkpointed(_shared(blocks))
    mixed = shared.filter("mixed")
    # One place for the bytes of each different block.
    first = mixed.groupBy("h", "c").agg(F.count("*").alias("weight"), F.min(F.struct("k1", "k2", "start")).alias("of"))
    ship = mixed.join(first.select("h", "c", "weight", "of.*"), ["h", "c", "k1", "k2", "start"])
    ship = ship.groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "c", "weight", "memory", "start", "n")).alias("ship"))
    passages = checkpointed(_word_blocks(keyed))
    words = passages.filter("compare").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "start", "n", "whole")).alias("words"))
    touched = shared.select("k1", "k2").distinct().join(ship, ["k1", "k2"], "left").join(words, ["k1", "k2"], "full")
    texts = checkpointed(keyed.join(touched, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "data", "ship", "words"))
    pieces = texts.select("data", F.inline("ship")).select(
        "h", "c", "weight", "memory", F.expr(f"substring(data, int(start + 1), int(n + {LENGTH - 1}))").alias("data"))
    apart = mixed.select("k1", "k2", "start", "h", "c").join(_settle(pieces, 0), ["h", "c"]).select("k1", "k2", "start", "ranges")
    alike = shared.filter("NOT mixed").select(
        "k1", "k2", "start", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"))).cast(RANGES).alias("ranges"))
    # A set: rows equal in id and text have one key, and the windows of all of them are those of one.
    ranges = alike.union(apart).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "ranges")).alias("windows"))

    def make():
        return lambda data, windows: [cut_out(d, [(w["start"] + r["a"], w["start"] + r["b"]) for w in ws for r in w["ranges"]])
                                      for d, ws in zip(raw(data), windows.to_pylist(), strict=True)]

    done = annotate(texts.select("k1", "k2", "data").join(ranges, ["k1", "k2"]), ["data", "windows"], FIELDS, make, "done", ["k1", "k2"])
    done = done.select("k1", "k2", "done.*", F.sha2("done.kept", 256).alias("sha"))
    every = keyed.select("doc_id", "k1", "k2", F.length("data").cast("bigint").alias("n_bytes"), F.sha2("data", 256).alias("whole"))
    counted = _covered(passages.filter("whole").select("k1", "k2", "start", "n").union(_word_windows(texts)))
    return every.join(done, ["k1", "k2"], "left").join(counted, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("spans", F.array().cast(T.ArrayType(SPAN, False))).alias("spans"), "kept",
        F.coalesce("sha", "whole").alias("kept_sha256"), F.coalesce("n_shared_words", F.lit(0).cast("bigint")).alias("n_shared_words"))
