from llm_rows import by_row
from pyspark.sql import functions as F

from check_oracle import compare, connect
from tracewell.llm import reputation as R
from tracewell.llm.queries import ORACLE_SQL, QUERIES

URLS = ["http://x.com/en/1", "http://example.com/en/2", "https://a.EXAMPLE.com/en/", "http://www.example.com/en/3",
        "http://shop.net/es/9", "http://shop.net/fr/", "http://shop.net/de/4", "http://shop.net", "http://com/", "http://xcom/en/",
        "ftp://U@Host.org:80?x=/es/", "no scheme", None, "://", "http://", "a://b://c/d", "http://x.net/ES/", "http://ü.net/es/1#f"]


def by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))
    path = rest[cut:end]
    fits = [(len(h + p), h + p, v) for v, h, p in R.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    for r in R.judge(pages, labels).collect():
        host, path, rule, verdict = by_hand(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_reputation_shrinks(spark):
    """A host with many bad pages is blocked; one bad page, or a new host of a good domain, is not."""
    urls, labels, k = [], [], 0
    for host, good, bad in (("spam.site.org", 0, 60), ("one.good.org", 0, 1), ("b.good.org", 50, 2), ("c.other.org", 40, 1), ("d.third.org", 30, 0)):
        for y in [1] * good + [0] * bad:
            k += 1
            urls.append((k, f"http://{host}/de/{k}.html"))
            labels.append((k, y))
    urls += [(1001, "http://new.good.org/de/x"), (1002, "http://new.site.org/de/x")]
    got = {r.host: r for r in R.judge(spark.createDataFrame(urls, "page_id long, url string"),
                                      spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert {h: r.verdict for h, r in got.items() if h.split(".")[0] in ("spam", "one", "b", "new")} == {
        "spam.site.org": "block", "one.good.org": "allow", "b.good.org": "allow", "new.good.org": "allow",
        "new.site.org": got["new.site.org"].verdict}
    assert (got["spam.site.org"].n_labelled, got["spam.site.org"].n_good) == (60, 0)


def test_levels(spark):
    want = {"b.a.co.uk:80": ("a.co.uk", "co.uk"), "a.co.uk": ("a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.org:80": ("x.org", "org"),
            "me@w.x.org": ("x.org", "org"), "org": ("org", "org"), "notco.uk": ("notco.uk", "uk"), "1.2.3.4:8080": ("1.2.3.4", ""),
            "[::1]:80": ("[::1]", ""), "": ("", ""), "a.b.com.br": ("b.com.br", "com.br"), "1.2.3.4.org": ("4.org", "org")}
    rows = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = R.levels(F.col("host"))
    assert {r.host: (r.d, r.s) for r in rows.select("host", domain.alias("d"), suffix.alias("s")).collect()} == want


def test_sites_below_a_shared_suffix_stand_apart(spark):
    """Bad pages of one site under co.uk do not make its neighbour one site with it; ports do not part a site."""
    urls, labels, k = [], [], 0
    for host, good, bad in (("a.bad.co.uk", 0, 40), ("b.bad.co.uk:8080", 0, 3), ("a.fine.co.uk", 40, 0), ("b.fine.co.uk", 0, 1), ("x.org", 30, 30)):
        for y in [1] * good + [0] * bad:
            k += 1
            urls.append((k, f"http://{host}/{k}"))
            labels.append((k, y))
    pages, marks = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.host: r.verdict for r in R.judge(pages, marks).collect()}
    assert got == {"a.bad.co.uk": "block", "b.bad.co.uk:8080": "block", "a.fine.co.uk": "allow", "b.fine.co.uk": "allow", "x.org": "allow"}
    counts = pages.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)).join(marks, F.col("page_id") == F.col("doc_id"))
    outcomes = counts.groupBy("host").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))
    mean = {r.host: r["mean"] for r in R.reputations(outcomes).collect()}
    assert mean["b.fine.co.uk"] > 0.5 > mean["b.bad.co.uk:8080"]


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1", "x"), (1, "http://a.org/1", "x"), (None, None, None)],
                                  "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = by_row(R.judge(pages, labels), "page_id", "host", "rule", "verdict", "n_labelled", "n_good")
    assert got == sorted([(1, "a.org", None, "allow", 2, 2)] * 2 + [(None, "", None, "allow", 0, 0)], key=repr)
    assert R.judge(pages.limit(0), labels).count() == 0
    assert R.judge(pages, labels.limit(0)).count() == 3


def test_query(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(QUERIES["op9_host_reputation"](spark, sf), connect(sf), ORACLE_SQL["op9_host_reputation"]) is None
