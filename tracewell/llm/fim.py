"""Fill-in-the-middle by displacement scatter.

A text is cut at two line ends into prefix, middle and suffix, and these are written
in another order between sentinels. For all texts of a batch at once: a scan finds
the cuts, a difference array takes the change of displacement at each cut, its
cumulative sum gives every byte the number of places it moves, and one scatter
writes them all. Restoring finds the sentinels in the output, builds the same
displacements from them and gathers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import annotate

#: Sentinels of prefix, suffix and middle; three bytes each, the letter in the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")

FIELDS = T.StructType([
    T.StructField("n", T.LongType(), False), T.StructField("form", T.StringType(), False),
    T.StructField("prefix_chars", T.LongType(), True), T.StructField("middle_chars", T.LongType(), True),
    T.StructField("output", T.StringType(), False)])
RESTORED = T.StructType([T.StructField("text", T.StringType(), False)])


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four numbers below 2^32 from the hash of seed and id; a null id draws like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins and the last ends; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = col.cast(pa.large_string())
    at = np.frombuffer(wide.buffers()[1], "i8")[wide.offset:wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    bytes_ = np.frombuffer(data, "u1")[at[0]:at[-1]] if data is not None and data.size else np.zeros(0, "u1")
    return bytes_, at - at[0]


def as_strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The inverse of :func:`buffer`."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, "i8")), pa.py_buffer(data)).cast(pa.string())


def sentinels(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the letters P, S, M between angle brackets, and the number of the text that holds all three bytes."""
    inner = np.flatnonzero((data == PREFIX[1]) | (data == SUFFIX[1]) | (data == MIDDLE[1]))
    inner = inner[(inner > 0) & (inner < len(data) - 1)]
    inner = inner[(data[inner - 1] == PREFIX[0]) & (data[inner + 1] == PREFIX[2])]
    where = np.searchsorted(at, inner, "right") - 1
    whole = (inner - 1 >= at[where]) & (inner + 1 < at[where + 1])
    return inner[whole], where[whole]


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of lines of each text, all line ends of the batch, and the first of them that is each text's own."""
    ends = np.flatnonzero(data == 10) + 1
    own = np.searchsorted(ends, at, "right")       # line ends up to the text's begin
    full = np.diff(own)
    size = np.diff(at)
    last = data[np.maximum(at[1:] - 1, 0)] if len(data) else np.zeros(len(size), "u1")
    return full + ((size > 0) & (last != 10)), ends, own[:-1]


def cut_at(k: np.ndarray, n: np.ndarray, at: np.ndarray, ends: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Byte behind the first ``k`` of ``n`` lines of each text."""
    inside = (k > 0) & (k < n)
    out = np.where(k > 0, at[1:], at[:-1])
    out[inside] = ends[own[inside] + k[inside] - 1]
    return out


def displaced(total: int, begin: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The displacement of each of ``total`` bytes: ``shift`` from each place of ``begin`` up to the next."""
    change = np.zeros(total + 1, "i8")
    # Empty pieces begin where the next one does: changes at one place add up.
    np.add.at(change, begin, np.diff(shift, prepend=0))
    return np.cumsum(change[:-1])


def rearrange(data: np.ndarray, at: np.ndarray, h: list[np.ndarray], plain_percent: int, spm_percent: int):
    """(n, form, first cut, second cut, output bytes, output begins) of all texts of a batch."""
    n, ends, own = lines(data, at)
    x, y = h[0] % (n + 1), h[1] % (n + 1)
    a, b = (cut_at(k, n, at, ends, own) for k in (np.minimum(x, y), np.maximum(x, y)))
    marked = np.zeros(len(n), bool)
    marked[sentinels(data, at)[1]] = True
    plain = (np.diff(at) == 0) | marked | (h[2] % 100 >= 100 - plain_percent)
    form = np.where(plain, PLAIN, np.where(h[3] % 100 < spm_percent, SPM, PSM))
    out_at = np.r_[0, np.cumsum(np.diff(at) + 9 * ~plain)]
    p, m, s = _pieces(form, at, a, b, out_at)
    begin = np.stack([at[:-1], a, b], 1).ravel()
    shift = np.stack([p, m, s], 1).ravel() - begin
    out = np.empty(out_at[-1], "u1")
    out[np.arange(len(data)) + displaced(len(data), begin, shift)] = data
    made = ~plain
    for place, word in ((p, PREFIX), (m, MIDDLE), (s, SUFFIX)):
        for k in range(3):
            out[place[made] - 3 + k] = word[k]
    return n, form, a, b, out, out_at


def _pieces(form, at, a, b, out_at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where prefix, middle and suffix begin in the output: each behind its sentinel, in plain texts without."""
    size, begin = at[1:] - at[:-1], out_at[:-1]
    np_, nm, ns = a - at[:-1], b - a, at[1:] - b
    psm, spm = form == PSM, form == SPM
    p = begin + np.where(psm, 3, np.where(spm, 6 + ns, 0))
    s = begin + np.where(psm, 6 + np_, np.where(spm, 3, size - ns))
    m = begin + np.where(psm | spm, 9 + np_ + ns, np_)
    return p, m, s


def restore_all(out: np.ndarray, out_at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text bytes and begins from outputs and forms alone. A sentinel cannot stand anywhere else in a made output:
    no text with one is cut, and a sentinel's ends do not go on into another."""
    made = form != PLAIN
    found, where = sentinels(out, out_at)
    found = found[made[where]]
    place = {}
    for word in (PREFIX, MIDDLE, SUFFIX):
        place[word] = np.zeros(len(form), "i8")
        place[word][made] = found[out[found] == word[1]] + 2
    size = np.diff(out_at) - 9 * made
    at = np.r_[0, np.cumsum(size)]
    p, m, s = (np.where(made, place[w], out_at[:-1]) for w in (PREFIX, MIDDLE, SUFFIX))
    end = out_at[1:]
    np_ = np.where(made, np.where(form == PSM, s - 3 - p, m - 3 - p), size)
    nm = np.where(made, end - m, 0)
    begin = np.stack([at[:-1], at[:-1] + np_, at[:-1] + np_ + nm], 1)
    shift = np.stack([p, m, s], 1) - begin
    return out[np.arange(at[-1]) + displaced(at[-1], begin.ravel(), shift.ravel())], at


def transform(docs: DataFrame, seed: int = 7, *, plain_percent: int = 0, spm_percent: int = 50, doc_id: str = "doc_id",
              text: str = "text", name: str = "fim", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct ``name``: lines ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The cuts are drawn from seed and id, so equal ids draw the same numbers. Null
    texts are empty; empty texts and texts with a sentinel in them are ``plain``, and
    their two lengths are null. Repeated rows get equal outputs, an empty table stays
    empty, other columns of any name pass through. A batch is held in slices of some
    megabytes, a longer text alone.
    """
    drawn = docs
    names = []
    for k, h in enumerate(draws(seed, F.col(doc_id))):
        names.append(f"_{name}_draw_{k}")
        while names[-1] in docs.columns:
            names[-1] = "_" + names[-1]
        drawn = drawn.withColumn(names[-1], h)

    def make():
        def work(col: pa.Array, *h: pa.Array) -> tuple:
            data, at = buffer(col)
            n, form, a, b, out, out_at = rearrange(data, at, [x.to_numpy() for x in h], plain_percent, spm_percent)
            chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            plain = form == PLAIN
            return (pa.array(n), pa.array(np.array(FORMS, object)[form], pa.string()),
                    pa.array(chars[a] - chars[at[:-1]], mask=plain), pa.array(chars[b] - chars[a], mask=plain), as_strings(out, out_at))

        return work

    return annotate(drawn, [text, *names], FIELDS, make, name, list(docs.columns if keep is None else keep))


def restore(made: DataFrame, output: str = "output", form: str = "form", *, name: str = "restored", keep: list[str] | None = None) -> DataFrame:
    """``made`` with a struct ``name`` whose ``text`` is rebuilt from the columns ``output`` and ``form``."""
    def make():
        def work(out: pa.Array, kinds: pa.Array) -> tuple:
            data, at = buffer(out)
            form = np.array([FORMS.index(k or "plain") for k in kinds.to_pylist()], "i8")
            return (as_strings(*restore_all(data, at, form)),)

        return work

    return annotate(made, [output, form], RESTORED, make, name, keep)


#: DuckDB SQL of the query.
SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         sha256('7:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(units) + 1) AS x,
         CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(units) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:least(x, y)], '') AS p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(units[greatest(x, y) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts"""
