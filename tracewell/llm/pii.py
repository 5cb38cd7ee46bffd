"""Personal data, also in disguise.

Identifiers are found twice: in the text as it stands, and in a normalised text. Two
transducers make the latter and keep, for each output character, the range of source
characters it stands for. The first maps look-alike letters and digits of other
alphabets to ASCII and drops invisible characters; the second rewrites "at" and "dot"
in their usual disguises and runs of spelled digits. What is detected in the
normalised text is mapped back through the ranges to the source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import annotate, fresh, per_worker, texts

KINDS = ("email", "ip", "card", "phone")

SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False),
                     T.StructField("end", T.LongType(), False), T.StructField("base", T.BooleanType(), False)])
FIELDS = T.StructType([T.StructField("spans", T.ArrayType(SPAN, False), False)])

# ---- detectors -----------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits begins: later starts meet the same end.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Anchored at each ``@``, so that a long run without one costs nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m.groups()):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if len(m[0]) >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        out += [(kind, *s) for kind, find in (("ip", ips), ("card", cards), ("phone", phones)) for s in find(text)]
    return out


# ---- transducers ---------------------------------------------------------------

# Look-alikes of Latin letters in Cyrillic and Greek.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
INVISIBLE = "­​‌‍‎‏⁠﻿"
NUMERALS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
            "eight": "8", "nine": "9"}
#: Fewest spelled digits in a run for it to be read as a number.
MIN_SPELLED = 4


def homoglyphs() -> dict[str, str]:
    """Characters to ASCII text: the look-alikes, digits of any script, and whatever has an ASCII compatibility form.

    Made once in a Python worker; a cache of the function itself would tie it to this module, which executors may lack.
    """
    return per_worker(("homoglyphs",), _homoglyphs)


def _homoglyphs() -> dict[str, str]:
    out = dict(LOOKALIKES) | dict.fromkeys(INVISIBLE, "")
    # Ideographs and Hangul have no such form, and no digits but for the scripts that lie between the two.
    for c in (chr(i) for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000 and not 0x3400 <= i < 0xA000 and not 0xAC00 <= i < 0xD800):
        if unicodedata.category(c) == "Nd":
            out[c] = str(unicodedata.digit(c))
        elif c not in out and len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii() and n.isprintable():
            out[c] = n
    return out


# Everything beyond Latin-1, and the few characters within it that the table can hold.
_ODD = re.compile("[\xa0\xaa\xad\xb2\xb3\xb7\xb9\xba]|[^\x00-\xff]")

_OPEN, _SHUT = r"[ \t]{0,3}[\[({<][ \t]{0,3}", r"[ \t]{0,3}[\])}>][ \t]{0,3}"
_AT, _DOT = r"(?:at|@)", r"(?:dot|punkt|point|punto|\.)"
_NAME, _HOST = r"[a-z0-9_%+-]{1,64}", r"[a-z0-9-]{1,63}"
_DIGIT_WORD = "(?:" + "|".join(NUMERALS) + ")"
_UNIT = rf"(?:{_DIGIT_WORD}|[0-9]++)(?![a-z0-9])"
BRACKETED = [(re.compile(_OPEN + _AT + _SHUT, re.I), "@"), (re.compile(_OPEN + _DOT + _SHUT, re.I), ".")]
# "name at host dot com": both words must be there, between parts of an address.
_SEP = r"(?:\.|[ \t]{1,3}dot[ \t]{1,3})"
SPOKEN = re.compile(rf"(?<![a-z0-9_%+-]){_NAME}(?:{_SEP}{_NAME}){{0,4}}(?:[ \t]{{1,3}}at[ \t]{{1,3}}|@){_HOST}(?:{_SEP}{_HOST}){{0,4}}?"
                    rf"[ \t]{{1,3}}dot[ \t]{{1,3}}{_HOST}(?:{_SEP}{_HOST}){{0,4}}", re.I)
SPOKEN_PART = re.compile(r"[ \t]{1,3}(at|dot)[ \t]{1,3}", re.I)
SPELLED = re.compile(rf"(?<![a-z0-9])(?:plus[ \t-]{{1,3}}|\+[ \t]?)?{_UNIT}(?:(?:[ \t,-]{{1,3}}(?:dot|point)[ \t,-]{{1,3}}|[ \t,.-]{{1,3}})"
                     rf"{_UNIT})++", re.I)
SPELLED_PART = re.compile(rf"{_DIGIT_WORD}|plus|dot|point|[0-9]+|[+.]", re.I)
# What a lower-cased text must hold for the rules above to find anything.
_BRACKET_CUE = re.compile(rf"[\[({{<][ \t]{{0,3}}(?:{_AT}|{_DOT})[ \t]{{0,3}}[\])}}>]")
_SPOKEN_CUE = re.compile(r"[ \t]dot[ \t]")
_SPELLED_CUE = re.compile(rf"(?<![a-z0-9]){_DIGIT_WORD}[ \t,.-]{{1,3}}(?:{_DIGIT_WORD}|[0-9]|dot|point)")


class Traced:
    """A text with, for each character, the range of source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)
        self.changed: list[tuple[int, int]] = []      # source ranges
        self.mixed = False      # whether a spelled run holds numerals of two or more digits

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint, ascending ranges; what comes in for a range stands for all of it."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [*self.start[at:a], *[self.start[a]] * len(new)]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)]
            self.changed.append((self.start[a], self.end[b - 1]))
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end = start + [*self.start[at:]], end + [*self.end[at:]]


def spelled_edits(text: str, m: re.Match, apart: bool) -> tuple[list[tuple[int, int, str]], bool]:
    """What makes a spelled run ``m`` a number, and whether numerals of two or more digits stand in it.

    Such a numeral may belong to the number or only follow it. It keeps the separators
    around it, or with ``apart`` is parted from the rest by a character of no identifier.
    """
    edits, at, before, some = [], m.start(), "", False
    for p in SPELLED_PART.finditer(text, *m.span()):
        word = p[0].lower()
        new = NUMERALS.get(word, {"plus": "+", "dot": ".", "point": "."}.get(word, word))
        numeral = word.isdigit() and len(word) > 1
        some |= numeral
        if before not in ("", "plus", "+", "dot", "point") and new.isdigit() and (numeral or before.isdigit() and len(before) > 1):
            if apart and at < p.start():
                edits.append((at, p.start(), "\n"))
                at = p.start()
            elif before != ".":
                at = p.start()
        if text[at:p.end()] != new:
            edits.append((at, p.end(), new))
        at, before = p.end(), word
    return edits, some


def normalise(text: str, apart: bool = False) -> Traced:
    """``apart``: numerals within spelled runs are parted from them; see :func:`spelled_edits`."""
    out, table = Traced(text), homoglyphs()
    if not text.isascii():
        out.rewrite([(*m.span(), table[m[0]]) for m in _ODD.finditer(text) if m[0] in table])
    low = out.text.lower()
    if _BRACKET_CUE.search(low):
        for pattern, new in BRACKETED:
            out.rewrite([(*m.span(), new) for m in pattern.finditer(out.text)])
    if _SPOKEN_CUE.search(low):
        out.rewrite([(*p.span(), "@" if p[1].lower() == "at" else ".") for m in SPOKEN.finditer(out.text)
                     for p in SPOKEN_PART.finditer(out.text, *m.span())])
    if sum(map(low.count, NUMERALS)) >= MIN_SPELLED and _SPELLED_CUE.search(low):
        edits = []
        for m in SPELLED.finditer(out.text):
            if sum(p[0].lower() in NUMERALS for p in SPELLED_PART.finditer(out.text, *m.span())) >= MIN_SPELLED:
                own, some = spelled_edits(out.text, m, apart)
                edits += own
                out.mixed |= some
        out.rewrite(edits)
    return out


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind, then start.

    A disguised span may overlap others of its kind, as the plain part of an identifier
    in disguise can match by itself; one that lies within another is left out.
    """
    out, traced = [(*s, True) for s in detect(text)], normalise(text)
    for reading in [traced, normalise(text, True)] if traced.mixed else [traced]:
        for kind, a, b in detect(reading.text) if reading.changed else ():
            start, end = min(reading.start[a:b]), max(reading.end[a:b])
            if any(x < end and start < y for x, y in reading.changed) \
                    and not any(k == kind and x <= start and end <= y for k, x, y, _ in out):
                out.append((kind, start, end, False))
    if traced.changed:
        out.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


def spans(docs: DataFrame, text: str = "text", *, name: str = "pii", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct ``name`` whose ``spans`` are (kind, start, end, base) in code points, end exclusive.

    Null and empty texts have none. Rows stand alone: repeated rows get the same
    spans, an empty table stays empty, other columns of any name pass through. Base
    matches are leftmost and do not overlap within a kind; kinds may overlap each
    other, and disguised spans reach over base ones. The detectors take time linear in the text, also on long runs of digits.
    """
    return annotate(docs, [text], FIELDS, lambda: lambda col: [(
        [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in find(t)],) for t in texts(col)], name, keep)


def redact(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """``text`` with each stretch of overlapping spans replaced by the kind of its first, longest span."""
    out, at, last = [], 0, -1
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[at:a], f"[{kind.upper()}]"]
        last = at = max(last, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[KIND]``; null stays null, columns keep their order."""
    name = fresh(docs, "clean")
    fields = T.StructType([T.StructField("text", T.StringType(), True)])
    out = annotate(docs, [text], fields, lambda: lambda col: [
        (None if t is None else redact(t, find(t)),) for t in col.to_pylist()], name,
        [c for c in docs.columns if c != text])
    return out.withColumn(text, F.col(f"{name}.text")).select(*docs.columns)
