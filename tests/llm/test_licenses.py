import math
import textwrap
from collections import Counter

from llm_rows import ODD

from tracewell.llm import licenses as L
from tracewell.llm.queries import QUERIES

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
FILES = [
    ("a/LICENSE", APACHE + "\nmore words that are not in any template here"), ("a/x.py", "print(1)"), ("a/b/y.py", f"# {MIT}\n" + "code = 1\n" * 20),
    ("a/b/c/z.py", None), ("a/b/c/d/COPYING", MIT), ("a/b/c/d/e/w.py", ""), ("top.py", "no licence"), (None, "no path"),
    ("b/only.txt", MIT), ("b/other.txt", "plain"), ("b/other.txt", "plain"), ("a/LICENSE-2", "x y z " + MIT),
    ("c/long.txt", "filler text " * 20000 + "\n" + APACHE)]
FILES += [(f"p/{i}.txt", f"ordinary text number {i} under the table") for i in range(40)]


def test_inheritance(spark):
    df = spark.createDataFrame([(p, t, "q") for p, t in FILES], "path string, text string, license string")
    rows = L.scan(df).collect()
    got = Counter((r.path, r.own, r.license, r.source_path) for r in rows)
    assert len(rows) == len(FILES)
    assert got >= Counter([
        ("a/LICENSE", "Apache-2.0", "Apache-2.0", None), ("a/x.py", None, "Apache-2.0", "a/LICENSE"), ("a/b/y.py", "MIT", "MIT", None),
        ("a/b/c/z.py", None, "Apache-2.0", "a/LICENSE"), ("a/b/c/d/e/w.py", None, "MIT", "a/b/c/d/COPYING"), ("top.py", None, None, None),
        (None, None, None, None), ("b/other.txt", None, "MIT", "b/only.txt"), ("b/other.txt", None, "MIT", "b/only.txt"),
        ("c/long.txt", "Apache-2.0", "Apache-2.0", None), ("p/1.txt", None, None, None)])


def test_root_licence(spark):
    df = spark.createDataFrame([("LICENSE", MIT), ("x/y/z.py", "code")] + [(f"f{i}", "text") for i in range(20)], "path string, text string")
    assert {r.license for r in L.scan(df).collect()} == {"MIT"}


def test_cosine_and_bound():
    """No pair that the bound leaves out is close, and the score is the plain cosine."""
    texts = [MIT, APACHE, "the of is to under this work license mit", "Licensed under CC BY-NC 4.0.", "licensed under apache mit gpl"]
    df = Counter()
    for t in texts:
        df.update(L.vocabulary(L.TEMPLATES) & set(L.words(t.encode())))
    m = L.Matcher(L.TEMPLATES, df, 500)
    for t in texts:
        v = {w: n * m.weight.get(w, m.other) for w, n in Counter(L.words(t.encode())).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        every = max(sum(x * u.get(w, 0) for w, x in v.items()) / size for _, u in m.vectors)
        assert m.scan(t.encode())[1] == (round(every, 6) if every >= L.CLOSE else 0.0)


def test_wrapped_notices():
    """Hard-wrapped files, comment headers and titles, with all words rare and with common words frequent."""
    common = dict.fromkeys("the of to and in or is this any for with a without that are".split(), 450)
    wrap = lambda text, mark="": "\n".join(mark + line for line in textwrap.wrap(text, 72))
    grant = L.FULL["MIT"][0].split("(c) ")[1]
    bsd = {k: L.FULL[k][0].split("(c) ")[1] for k in ("BSD-2-Clause", "BSD-3-Clause")}
    apache = L.TEMPLATES["Apache-2.0"][2]
    gpl = L.TEMPLATES["GPL-3.0"][2]
    for df in ({}, common):
        m = L.Matcher(L.TEMPLATES, df, 500)
        for want, text in (
                ("MIT", "MIT License\n\nCopyright (c) 2021 Some Body\n\n" + wrap(grant)),
                ("MIT", "/*\n" + wrap(grant.split("conditions:")[0] + "conditions:", " * ") + "\n */\nint main() { return run(); }\n" * 9),
                *((k, f"Copyright (c) 2020, Some Body\nAll rights reserved.\n\n{wrap(t)}\n") for k, t in bsd.items()),
                ("Apache-2.0", wrap(apache, "# ") + "\n#\n# more about other things\nx = compute(1)\n"),
                ("GPL-3.0", wrap(gpl, "// ") + "\n\ncode();\n"),
                ("GPL-3.0", "      GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\nsomething else\n"),
                ("GPL-2.0", "      GNU GENERAL PUBLIC LICENSE\n      Version 2, June 1991\n\nsomething else\n")):
            assert m.scan(text.encode())[0] == want, (want, text)
        assert m.scan(b"an ordinary text\nover two lines of the kind\n\nwith a second paragraph")[0] is None


def test_rows(odd, none):
    with_path = odd.selectExpr("*", "concat('d/', doc_id) AS path")
    assert L.scan(with_path).count() == len(ODD)
    assert L.scan(none.selectExpr("*", "text AS path")).count() == 0


def test_query_finds_every_notice(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op10_license_scan"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    assert {r.doc_id for r in rows if r.own} == {d for d, t in docs.items() if "licensed under" in t.lower() or "MIT License" in t}
