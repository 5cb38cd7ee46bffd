"""License scan: TF-IDF cosine to templates, then inheritance from the nearest directory above.

Each line, paragraph and sentence of a text is a sparse vector of its words, weighted by
how rare they are in the corpus; sentences run on over the lines of a paragraph. A
template that is close to one marks the file, and a whole text that is close to a full
licence has that one. A file that
consists of such text for the most part, or is named like a licence file, also marks
its directory, and every file without a licence of its own takes that of the nearest
directory above it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import annotate, checkpointed, raw
from tracewell.llm.decontaminate import normalise

# Notices by SPDX id, as their authors recommend them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 into the public domain.", "SPDX-License-Identifier: CC0-1.0"),
}
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
          "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
          "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
          "the Software is furnished to do so, subject to the following conditions:")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
          "derived from this software without specific prior written permission.")
_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
          "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
          "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
          "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
          "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
          "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# Full licence texts by SPDX id, for whole files.
FULL: dict[str, tuple[str, ...]] = {
    "MIT": (f"MIT License Copyright (c) {_GRANT} The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
            "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
            "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
            "SOFTWARE.",),
    "BSD-2-Clause": (f"BSD 2-Clause License Copyright (c) {_BSD} {_AS_IS}",),
    "BSD-3-Clause": (f"BSD 3-Clause License Copyright (c) {_BSD} {_NAMES} {_AS_IS}",),
}
TEMPLATES["MIT"] += (_GRANT,)
# Titles of the longer licences; a version of its own has a title of its own.
for _id, _title in (("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
                    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
                    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
                    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
                    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
                    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
                    ("MPL-2.0", "Mozilla Public License Version 2.0")):
    TEMPLATES[_id] = (*TEMPLATES.get(_id, ()), _title)
#: Least cosine of a block to a template.
CLOSE = 0.75
#: Share of a text's words in such blocks that makes it a licence file.
MOSTLY = 0.5
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
_BLOCK = re.compile(rb"[^\n]*?[.!?;:](?=[ \t\r\n]|$)|[^\n]+")

_MARK = re.compile(rb"^[ \t]*(?://+|/\*+|\*+/?|#+|--+|;+|%+|<!--+)?|[ \t\r]*(?:\*+/|--+>)?[ \t\r]*$")

FIELDS = T.StructType([T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType(), False),
                       T.StructField("block", T.StringType()), T.StructField("share", T.DoubleType(), False)])


def words(data: bytes) -> list[str]:
    return normalise(data).decode().split(" ")[1:-1]


def blocks(line: bytes) -> list[bytes]:
    """A line and, if it has several, its sentences."""
    parts = _BLOCK.findall(line)
    return [line, *parts] if len(parts) > 1 else [line]


def paragraphs(data: bytes) -> Iterator[list[bytes]]:
    """Lines in a row that hold more than a comment mark."""
    now: list[bytes] = []
    for line in data.split(b"\n"):
        if _MARK.sub(b"", line).strip():
            now.append(line)
        elif now:
            yield now
            now = []
    if now:
        yield now


class Matcher:
    """Templates as unit vectors under the weights of a corpus."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], frequency: Mapping[str, int], total: int,
                 full: Mapping[str, tuple[str, ...]] = FULL):
        self.weight = {w: math.log((1 + total) / (1 + frequency.get(w, 0))) + 1 for w in vocabulary(templates) | vocabulary(full)}
        #: Words of no template only lengthen a vector; they count as seen in one text.
        self.other = math.log((1 + total) / 2) + 1
        self.vectors, self.full = self._units(templates), self._units(full)

    def _units(self, templates: Mapping[str, tuple[str, ...]]) -> list[tuple[str, dict[str, float]]]:
        out = []
        for name, lines in sorted(templates.items()):
            for line in lines:
                v = {w: n * self.weight[w] for w, n in Counter(words(line.encode())).items()}
                size = math.sqrt(sum(x * x for x in v.values()))
                out.append((name, {w: x / size for w, x in v.items()}))
        return out

    def near(self, seen: set[str], among: list[tuple[str, dict[str, float]]] | None = None) -> list[tuple[str, dict[str, float]]]:
        """Templates that a text with these words could be close to: no cosine exceeds the
        length of the template's part that lies in the words."""
        hits = self.weight.keys() & seen
        return [v for v in (self.vectors if among is None else among) if sum(v[1].get(w, 0.0) ** 2 for w in hits) >= CLOSE * CLOSE - 1e-9] if len(hits) > 1 else []

    def best(self, block: list[str], among: list[tuple[str, dict[str, float]]]) -> tuple[float, str]:
        count = Counter(block)
        size = math.sqrt(sum((n * self.weight.get(w, self.other)) ** 2 for w, n in count.items()))
        dots = [(sum(n * self.weight[w] * v[w] for w, n in count.items() if w in v) / size, name) for name, v in among]
        return min(dots, key=lambda d: (-d[0], d[1]))

    def scan(self, data: bytes) -> tuple[str | None, float, str | None, float]:
        all_words = words(data)
        seen = set(all_words)
        if whole := self.near(seen, self.full):
            score, name = self.best(all_words, whole)
            if score >= CLOSE:
                return name, round(score, 6), data.decode("utf-8", "replace").strip(), 1.0
        found: tuple[float, str, bytes] | None = None
        covered = 0

        def hit(block: bytes) -> int:
            """Words of ``block`` if it is close to a template."""
            nonlocal found
            own = words(block)
            if not (close := self.near(set(own)) if own else []):
                return 0
            score, name = self.best(own, close)
            if score < CLOSE:
                return 0
            if found is None or score > found[0]:
                found = (score, name, block)
            return len(own)

        for lines in paragraphs(data) if self.near(seen) else ():
            joined = b" ".join(_MARK.sub(b"", line) for line in lines)
            if not self.near(set(words(joined))):
                continue
            hits = sum(max(map(hit, blocks(line))) for line in lines)
            if len(lines) > 1:
                first, *parts = map(hit, blocks(joined))
                hits = max(hits, first, sum(parts))
            covered += hits
        if found is None:
            return None, 0.0, None, 0.0
        return found[1], round(found[0], 6), found[2].decode("utf-8", "replace").strip(), covered / len(all_words)


def vocabulary(templates: Mapping[str, tuple[str, ...]]) -> set[str]:
    return {w for lines in templates.values() for line in lines for w in words(line.encode())}


def document_frequency(files: DataFrame, text: str, templates: Mapping[str, tuple[str, ...]]) -> tuple[dict[str, int], int]:
    """Number of texts with each word of the templates, and of all texts: counted over the whole corpus.

    A task sends its own counts, at most a row for each word, and the driver gets their
    sums: the templates bound both.
    """
    known = vocabulary(templates) | vocabulary(FULL)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Counter(), 0
        for batch in batches:
            for data in raw(batch.column(0)):
                seen.update(known.intersection(words(data)))
            total += batch.num_rows
        seen[""] = total
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = files.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = {r.word: r.n for r in rows}
    return out, out.pop("", 0)


def scan(files: DataFrame, *, path: str = "path", text: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
         keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep.., path, license, score, block, own, source_path) for every row of ``files``.

    ``own`` is the file's own licence, ``score`` the cosine and ``block`` the text behind
    it. ``license`` is ``own``, else that of the nearest directory above with a licence
    file, which ``source_path`` names. Of several licence files of a directory the one
    with the highest score counts, then the smallest path.

    Null and empty texts have no licence of their own; a null path lies in no directory,
    so nothing is inherited. Repeated rows give a row each. Whole texts are read twice
    (word counts, cosines) and not shuffled; inheritance joins distinct directories,
    so a directory with a third of all files is one row there.
    """
    kept = [*dict.fromkeys([*keep, path])]
    found, total = document_frequency(files, text, templates)

    def make():
        matcher = Matcher(templates, found, total)
        return lambda col: [matcher.scan(b) for b in raw(col)]

    marked = checkpointed(annotate(files, [text], FIELDS, make, "own_license", kept))
    where, own = F.col(path), F.col("own_license")
    folder = F.regexp_extract(where, r"^(.*)/[^/]*$", 1)
    isfile = own.license.isNotNull() & ((own.share >= MOSTLY) | where.rlike(LICENSE_NAME))
    rank = F.struct((-own.score).alias("s"), where.alias("source"), own.license.alias("license"))
    folders = marked.filter(isfile & where.isNotNull()).groupBy(folder.alias("above")).agg(F.min(rank).alias("best"))
    dirs = marked.filter(where.isNotNull() & own.license.isNull()).select(folder.alias("dir")).distinct()
    steps = F.size(F.split("dir", "/"))
    ups = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), steps))).alias("depth")).select(
        "dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("above"))
    nearest = ups.join(folders, "above").groupBy("dir").agg(F.max(F.struct("depth", "best.source", "best.license")).alias("from"))
    out = marked.withColumn("lookup", F.when(own.license.isNull(), folder)).join(nearest, F.col("lookup") == F.col("dir"), "left")
    return out.select(*kept, F.coalesce(own.license, F.col("from.license")).alias("license"), own.score.alias("score"),
                      own.block.alias("block"), own.license.alias("own"), F.col("from.source").alias("source_path"))
