"""URL filter: fixed rules first, else the reputation of the host by empirical Bayes.

Labelled page outcomes are counted by host. Each level shrinks towards the one above
with a beta-binomial prior: host to registered domain, domain to suffix, suffix to
all pages. How strongly is learned from the data: the spread of the children's rates
around their parents', beyond what counting alone would give, is the correlation
within a child, and the prior weighs as much as ``1 / correlation - 1`` outcomes. A host
is blocked when even the upper bound of its posterior is low.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import checkpointed

#: (verdict, host, path prefix); a rule holds for the host and all its subdomains.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Blocked below this rate of good pages, at so many standard deviations above the mean.
LEAST_GOOD, DEVIATIONS = 0.5, 1.645
#: Bounds of the correlation; prior outcomes between 1 and 999.
CORRELATION = (0.001, 0.5)
#: Used where the data do not show a correlation, as with one child only.
UNKNOWN_CORRELATION = 0.1

#: Public suffixes of two labels that many sites register below. A host of any other has its last label as suffix.
SUFFIXES = ("ac.jp", "ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br",
            "com.cn", "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "edu.au", "edu.cn",
            "gov.au", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.uk")
_SHARED = "|".join(x.replace(".", "[.]") for x in SUFFIXES)
#: User and port are no part of a site's name; an address has no domain above it.
_USER, _PORT, _ADDRESS = "^.*@", ":[0-9]*$", r"^([0-9]+([.][0-9]+){3}|\[.*)$"
_SUFFIX, _DOMAIN = f"(?:^|[.])({_SHARED}|[^.]*)$", f"(?:^|[.])((?:[^.]+[.])?(?:{_SHARED})|[^.]*[.]?[^.]*)$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``; both are empty for a null url or one without ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def rule_of(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (then the smallest text), null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host: ``b.a.co.uk:80`` is of ``a.co.uk`` and ``co.uk``. An address is its own
    domain and has the empty suffix, as has the empty host."""
    name = F.regexp_replace(F.regexp_replace(host, _USER, ""), _PORT, "")
    address = name.rlike(_ADDRESS)
    return (F.when(address, name).otherwise(F.regexp_extract(name, _DOMAIN, 1)),
            F.when(address, "").otherwise(F.regexp_extract(name, _SUFFIX, 1)))


def _correlation(children: DataFrame, n: str, k: str, up_n: str, up_k: str) -> float:
    """Correlation of outcomes within a child, pooled over all children with outcomes.

    Terms are summed as decimals, so the sum does not depend on the partitioning.
    """
    q = F.try_divide(F.col(up_k), F.col(up_n))
    extra = F.try_divide(F.pow(F.col(k) - F.col(n) * q, F.lit(2)), F.col(n)) - q * (1 - q)
    room = (F.col(n) - 1) * q * (1 - q)
    over, under = (F.sum(c.cast("decimal(38,12)")).cast("double") for c in (extra, room))
    a, b = children.filter(F.col(n) > 0).agg(over, under).first()
    return min(CORRELATION[1], max(CORRELATION[0], a / b)) if b else UNKNOWN_CORRELATION


def reputations(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (host, n, good), a row for each host, with ``mean`` and ``deviation`` of the posterior.

    Hosts without outcomes take over their domain's, suffix's or overall rate.
    """
    domain, suffix = levels(F.col("host"))
    hosts = outcomes.withColumns({"domain": domain, "suffix": suffix})
    total = lambda by, n, k: hosts.groupBy(*by).agg(F.sum("n").alias(n), F.sum("good").alias(k))
    suffixes, domains = total(["suffix"], "ns", "ks"), total(["suffix", "domain"], "nd", "kd")
    n0, k0 = (x or 0 for x in outcomes.agg(F.sum("n"), F.sum("good")).first())
    below_s, below_d = domains.join(suffixes, "suffix"), hosts.join(domains, ["suffix", "domain"])
    prior = [1 / r - 1 for r in (
        _correlation(suffixes.withColumns({"n0": F.lit(n0), "k0": F.lit(k0)}), "ns", "ks", "n0", "k0"),
        _correlation(below_s, "nd", "kd", "ns", "ks"), _correlation(below_d, "n", "good", "nd", "kd"))]
    shrunk = lambda n, k, m, up: (F.col(k) + F.lit(m) * up) / (F.col(n) + F.lit(m))
    s = suffixes.withColumn("ms", shrunk("ns", "ks", prior[0], F.lit((k0 + 1) / (n0 + 2))))
    d = domains.join(s, "suffix").withColumn("md", shrunk("nd", "kd", prior[1], F.col("ms"))).select("suffix", "domain", "md")
    a = F.col("good") + F.lit(prior[2]) * F.col("md")
    b = F.col("n") - F.col("good") + F.lit(prior[2]) * (1 - F.col("md"))
    return hosts.join(d, ["suffix", "domain"]).select(
        "host", "n", "good", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))


def judge(pages: DataFrame, labels: DataFrame, *, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id",
          label: str = "quality", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, n_good) for every row of ``pages``.

    The outcome of a page is the label of the document whose number ends its path
    (``/en/8423``, ``/1837/``, ``/4033.html``); an id labelled twice has the larger label,
    null labels are passed over. Pages are counted by host and number first, so a host
    with a third of all pages is a few rows before anything is shuffled by host.

    Null urls and urls without ``://`` have an empty host and path, which has a
    reputation like any other. Repeated pages count as often as they occur. Empty
    tables give an empty result, or the prior alone.
    """
    seen = parsed(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(\.html|/)?$", 1)
    counted = seen.groupBy("host", F.nullif(number, F.lit("")).cast("bigint").alias("number")).agg(F.count("*").alias("pages"))
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(label_id).cast("bigint").alias("number")).agg(
        F.max(label).cast("bigint").alias("y"))
    outcomes = counted.join(known, "number", "left").groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("y").isNotNull(), F.col("pages"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("y") > 0, F.col("pages"))), F.lit(0)).alias("good"))
    reputed = reputations(checkpointed(outcomes))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    low = F.col("mean") + DEVIATIONS * F.col("deviation") < LEAST_GOOD
    return seen.join(reputed, "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(low, "block").otherwise("allow")).alias("verdict"),
        F.col("n").alias("n_labelled"), F.col("good").alias("n_good"))


def _sql() -> str:
    """The query over ``pages`` and ``labels`` as DuckDB SQL."""
    rule, verdict = "", ""
    for what, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN"
        rule, verdict = f"{rule} {fits} '{h}{p}'", f"{verdict} {fits} '{what}'"

    def prior(children: str, n: str, k: str, up_n: str, up_k: str) -> str:
        q = f"({up_k}::DOUBLE / {up_n})"
        return (f"SELECT 1e0 / CASE WHEN b = 0 OR b IS NULL THEN {UNKNOWN_CORRELATION}e0 ELSE least({CORRELATION[1]}e0, greatest({CORRELATION[0]}e0, a / b)) END - 1e0 AS m "
                f"FROM (SELECT sum(CAST(pow({k} - {n} * {q}, 2) / {n} - {q} * (1e0 - {q}) AS DECIMAL(38,12)))::DOUBLE AS a, "
                f"sum(CAST(({n} - 1) * {q} * (1e0 - {q}) AS DECIMAL(38,12)))::DOUBLE AS b FROM {children} WHERE {n} > 0)")

    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
known AS (SELECT doc_id, max(quality) AS y FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, CAST(count(y) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE y > 0) AS BIGINT) AS good
  FROM seen LEFT JOIN known ON known.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(\\.html|/)?$', 1) AS BIGINT) GROUP BY host),
named AS (SELECT *, regexp_replace(regexp_replace(host, '{_USER}', ''), '{_PORT}', '') AS name FROM counted),
hosts AS (SELECT host, n, good, CASE WHEN regexp_matches(name, '{_ADDRESS}') THEN name ELSE regexp_extract(name, '{_DOMAIN}', 1) END AS domain,
  CASE WHEN regexp_matches(name, '{_ADDRESS}') THEN '' ELSE regexp_extract(name, '{_SUFFIX}', 1) END AS suffix FROM named),
domains AS (SELECT suffix, domain, sum(n) AS nd, sum(good) AS kd FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n) AS ns, sum(good) AS ks FROM hosts GROUP BY suffix),
whole AS (SELECT sum(n) AS n0, sum(good) AS k0 FROM hosts),
p1 AS ({prior("suffixes, whole", "ns", "ks", "n0", "k0")}),
p2 AS ({prior("domains JOIN suffixes USING (suffix)", "nd", "kd", "ns", "ks")}),
p3 AS ({prior("hosts JOIN domains USING (suffix, domain)", "n", "good", "nd", "kd")}),
s AS (SELECT suffix, (ks + m * ((k0 + 1)::DOUBLE / (n0 + 2))) / (ns + m) AS ms FROM suffixes, p1, whole),
d AS (SELECT suffix, domain, (kd + m * ms) / (nd + m) AS md FROM domains JOIN s USING (suffix), p2),
h AS (SELECT host, n, good, good + m * md AS a, n - good + m * (1e0 - md) AS b FROM hosts JOIN d USING (suffix, domain), p3)
SELECT page_id, host, path, CASE{rule} END AS rule,
  CASE{verdict} WHEN a / (a + b) + {DEVIATIONS}e0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1e0))) < {LEAST_GOOD}e0 THEN 'block' ELSE 'allow' END AS verdict,
  n AS n_labelled, good AS n_good
FROM seen JOIN h USING (host)"""


SQL = _sql()
