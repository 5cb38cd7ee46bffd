"""Column expressions shared by every operator family.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; nothing here is a Python UDF. Event time travels as epoch seconds
(``BIGINT``), and every calendar function takes an explicit ``tz``. The
calendar arithmetic does not depend on the session time zone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Numbers above the cutoff (2100-01-01 in seconds) are milliseconds.
MILLIS_CUTOFF = 4102444800
MODEL_TIERS = ("opus", "sonnet", "haiku")
DEFAULT_TIER = "opus"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- numbers ---------------------------------------------------------------

def rnd(c: Column | str, digits: int = 0) -> Column:
    """Round half up with plain double arithmetic.

    ``round`` works on the decimal text of a double, so its ties depend on the
    engine; ``floor(x * 10^n + 0.5) / 10^n`` gives the same bits everywhere. From
    2^52 units on a double has no digits left to round, so it stays as it is.
    """
    scale, x = F.lit(float(10**digits)), _c(c).cast("double")
    return F.when(F.abs(x * scale) < F.lit(float(2**52)), F.floor(x * scale + F.lit(0.5)) / scale).otherwise(x)


def exact_total(c: Column | str) -> Column:
    """Sum as a decimal that does not depend on the order of addition, hence on partitioning and retries.

    Values are taken to the grid of nine decimals and added as whole numbers: units,
    ten-thousandths and the rest of the grid apart, so the last two cannot overflow below
    9 * 10^13 rows. A value or sum beyond 64 bits is an error. NULL without values.
    """
    x = _c(c).cast("double")
    whole = x.cast("bigint")
    grid = F.rint((x - whole) * F.lit(1e9)).cast("bigint")
    low = grid % F.lit(100_000)
    units = F.sum(((grid - low) / F.lit(100_000)).cast("bigint")).cast("decimal(20,0)") * F.lit(100_000) + F.sum(low)
    return F.sum(whole).cast("decimal(28,9)") + (units.cast("decimal(24,0)") * F.lit(Decimal("0.000000001"))).cast("decimal(28,9)")


def exact_sum(c: Column | str) -> Column:
    """:func:`exact_total`, turned into a double once at the end."""
    return exact_total(c).cast("double")


def mean(c: Column | str) -> Column:
    """Average over an exact sum; NULL without values. Nothing is rounded before the division."""
    return F.try_divide(exact_sum(c), F.count(_c(c)))


def pct(part: Column, total: Column, digits: int = 1) -> Column:
    """Percentage, NULL when ``total`` is zero."""
    return rnd(F.try_divide(part * F.lit(100.0), total), digits)


def ratio(part: Column, total: Column) -> Column:
    return F.try_divide(part.cast("double"), total.cast("double"))


def count_if(cond: Column) -> Column:
    """Rows satisfying ``cond``; 0 (not NULL) on empty input."""
    return F.count_if(cond)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit(0))


# ---- missing values --------------------------------------------------------

def falsy(c: Column | str) -> Column:
    """NULL or zero, which the scoring rules treat alike."""
    c = _c(c)
    return c.isNull() | (c == 0)


def truthy_or(c: Column | str, default: Column) -> Column:
    """The value unless it is NULL or zero."""
    c = _c(c)
    return F.when(falsy(c), default).otherwise(c)


def nonblank(*cols: Column | str, default: str | None = None) -> Column:
    """First value that is neither NULL nor the empty string."""
    parts = [F.nullif(_c(c), F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


# ---- calendar --------------------------------------------------------------

def local_seconds(ts: Column | str, tz: str = "UTC") -> Column:
    """Wall-clock seconds of an epoch in ``tz``."""
    ts = _c(ts)
    if tz == "UTC":
        return ts.cast("bigint")
    return F.unix_timestamp(F.from_utc_timestamp(F.timestamp_seconds(ts), tz))


def _floor_div(c: Column, n: int) -> Column:
    return F.floor(c / F.lit(n))


def local_date(ts: Column | str, tz: str = "UTC") -> Column:
    days = _floor_div(local_seconds(ts, tz), 86400).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def day_of(ts: Column | str, tz: str = "UTC") -> Column:
    """``YYYY-MM-DD`` of an epoch."""
    return local_date(ts, tz).cast("string")


def hour_of(ts: Column | str, tz: str = "UTC") -> Column:
    return F.pmod(_floor_div(local_seconds(ts, tz), 3600), F.lit(24)).cast("bigint")


def clock_of(ts: Column | str, tz: str = "UTC") -> Column:
    """``HH:MM:SS`` of an epoch."""
    s = F.pmod(local_seconds(ts, tz), F.lit(86400))
    return F.format_string(
        "%02d:%02d:%02d", _floor_div(s, 3600), F.pmod(_floor_div(s, 60), F.lit(60)), F.pmod(s, F.lit(60)))


def datetime_of(ts: Column | str, tz: str = "UTC") -> Column:
    """``YYYY-MM-DD HH:MM:SS`` of an epoch."""
    return F.concat(day_of(ts, tz), F.lit(" "), clock_of(ts, tz))


def hour_start(ts: Column | str, tz: str = "UTC") -> Column:
    """``YYYY-MM-DD HH:00:00`` of an epoch."""
    return F.concat(day_of(ts, tz), F.format_string(" %02d:00:00", hour_of(ts, tz)))


def month_day(d: Column | str) -> Column:
    """``MM/DD`` label. Sort by the date itself, never by this label."""
    return F.date_format(_c(d).cast("date"), "MM/dd")


def month_of(day: Column | str) -> Column:
    return F.substring(_c(day).cast("string"), 1, 7)


def weekday_name(d: Column | str) -> Column:
    return F.date_format(_c(d).cast("date"), "EEEE")


def iso_hour(text: Column | str) -> Column:
    """Hour cut from ISO text (characters 12 and 13), NULL when not a number."""
    return F.substring(_c(text), 12, 2).try_cast("int").cast("bigint")


def event_ts(x: Column | str) -> Column:
    """Instant from ISO text, ISO text with a zone, seconds, milliseconds or
    numeric text. Anything else gives NULL. Text without a zone is read in the
    session time zone."""
    x = _c(x).cast("string")
    d = x.try_cast("double")
    number = F.timestamp_seconds(F.when(d > MILLIS_CUTOFF, d / 1000).otherwise(d))
    return F.when(d.isNotNull(), number).otherwise(F.try_to_timestamp(x))


def minutes_between(start: Column | str, end: Column | str, digits: int = 1) -> Column:
    return rnd((_c(end) - _c(start)) / F.lit(60.0), digits)


def duration_text(seconds: Column | str) -> Column:
    """``H:MM:SS``, with a day prefix from 24 hours on."""
    s = _c(seconds).cast("bigint")
    days = _floor_div(s, 86400)
    clock = F.format_string(
        "%d:%02d:%02d",
        F.pmod(_floor_div(s, 3600), F.lit(24)), F.pmod(_floor_div(s, 60), F.lit(60)), F.pmod(s, F.lit(60)))
    prefix = F.when(days == 1, F.lit("1 day, ")).when(
        days > 1, F.concat(days.cast("string"), F.lit(" days, "))).otherwise(F.lit(""))
    return F.concat(prefix, clock)


def elapsed_minutes(text: Column | str) -> Column:
    """Minutes in ``[D-]HH:MM:SS`` or ``MM:SS``; other shapes count 0."""
    t = _c(text)
    dashed = F.split(t, "-")
    has_days = F.size(dashed) == 2
    days = F.when(has_days, dashed[0].try_cast("bigint")).otherwise(F.lit(0))
    parts = F.split(F.when(has_days, F.get(dashed, F.lit(1))).otherwise(t), ":")
    first = F.get(parts, F.lit(0)).try_cast("bigint")
    second = F.get(parts, F.lit(1)).try_cast("bigint")
    clock = F.when(F.size(parts) == 3, first * 60 + second).when(F.size(parts) == 2, first).otherwise(F.lit(0))
    return days * 1440 + clock


def age_label(hours: Column | str) -> Column:
    """Age as minutes, hours or days, by size."""
    h = _c(hours)
    return (
        F.when(h < 1, F.concat(F.floor(h * 60).cast("string"), F.lit("m ago")))
        .when(h < 24, F.concat(fixed(h, 1), F.lit("h ago")))
        .otherwise(F.concat(fixed(h / 24, 1), F.lit("d ago"))))


# ---- text ------------------------------------------------------------------

def fixed(c: Column, digits: int) -> Column:
    """Fixed-point text of a non-negative number."""
    scale = 10**digits
    units = F.floor(c.cast("double") * float(scale) + 0.5)
    whole = _floor_div(units, scale).cast("string")
    if digits == 0:
        return whole
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(units, F.lit(scale)).cast("string"), digits, "0"))


def humanize(n: Column | str) -> Column:
    """1234 -> 1.2K, with M and B above."""
    n = _c(n)
    return (
        F.when(n >= 1e9, F.concat(fixed(n / 1e9, 1), F.lit("B")))
        .when(n >= 1e6, F.concat(fixed(n / 1e6, 1), F.lit("M")))
        .when(n >= 1e3, F.concat(fixed(n / 1e3, 1), F.lit("K")))
        .otherwise(F.coalesce(n.cast("string"), F.lit("0"))))


def money_text(n: Column | str) -> Column:
    n = _c(n)
    return (
        F.when(n >= 1e3, F.concat(F.lit("$"), fixed(n / 1e3, 1), F.lit("K")))
        .when(n >= 1, F.concat(F.lit("$"), fixed(n, 2)))
        .otherwise(F.concat(F.lit("$"), fixed(n, 4))))


def tier_of(model: Column | str, default: str | None = DEFAULT_TIER,
            tiers: Sequence[str] = MODEL_TIERS) -> Column:
    """Model tier by substring; the first match wins."""
    m = F.coalesce(_c(model), F.lit(""))
    out = F.when(m.contains(tiers[0]), F.lit(tiers[0]))
    for t in tiers[1:]:
        out = out.when(m.contains(t), F.lit(t))
    return out.otherwise(F.lit(default))


def alias_of(text: Column | str, groups: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """Name of the alias group a word belongs to, ignoring case."""
    t = F.lower(_c(text))
    out = None
    for name, words in groups.items():
        cond = t.isin(*words)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(default))


def first_token(text: Column | str, default: str = "unknown") -> Column:
    return nonblank(F.get(F.split(F.trim(_c(text)), r"\s+"), F.lit(0)), default=default)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def preview(text: Column | str, n: int) -> Column:
    return F.substring(_c(text), 1, n)


def keyword_weight(text: Column | str, weights: Mapping[str, float], default: float) -> Column:
    """Largest weight among the keywords the text contains, at least ``default``."""
    t = F.lower(_c(text))
    hits = [F.when(t.contains(k), F.lit(float(w))).otherwise(F.lit(float(default))) for k, w in weights.items()]
    return F.greatest(F.lit(float(default)), *hits)


def canonical_hash(cols: Sequence[str]) -> Column:
    """MD5 of the row as JSON with keys in name order."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"}))


def with_defaults(m: Column | str, defaults: Mapping[str, float]) -> Column:
    """Map with ``defaults`` for its missing keys."""
    m = _c(m)
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    extra = F.map_filter(base, lambda k, _v: ~F.map_contains_key(m, k))
    return F.coalesce(F.map_concat(extra, m), base)
