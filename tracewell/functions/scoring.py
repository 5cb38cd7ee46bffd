"""Row-level scoring rules as columns, with their fixed thresholds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.exprs import _c, clamp, keyword_weight, rnd, truthy_or

# Fixed values. USD per million tokens: input, output, cache read.
PRICES: dict[str, dict[str, float]] = {
    "opus": {"input": 5.0, "output": 25.0, "cache": 0.5},
    "sonnet": {"input": 3.0, "output": 15.0, "cache": 0.3},
    "haiku": {"input": 1.0, "output": 5.0, "cache": 0.1},
}
# Fixed values. The stored daily-cost view prices the small tier differently and ignores cache reads.
VIEW_PRICES: dict[str, dict[str, float]] = {
    "opus": {"input": 5.0, "output": 25.0},
    "sonnet": {"input": 3.0, "output": 15.0},
    "haiku": {"input": 0.8, "output": 4.0},
}
MONTHLY_RATE = 200.0
# Fixed values. Weights of a model call in the efficiency of a session.
EFFICIENCY_WEIGHTS = {"haiku": 1.0, "sonnet": 0.8, "opus": 0.5}
# Fixed values. Cost of a routed query relative to the largest model.
RELATIVE_COST = {"haiku": 0.16, "sonnet": 0.6, "opus": 1.0}
# Fixed values. Complexity signalled by a keyword in a query.
COMPLEXITY_SIGNALS = {"architecture": 0.9, "design": 0.8, "implement": 0.6, "fix": 0.4, "simple": 0.2,
                      "quick": 0.2, "explain": 0.3, "refactor": 0.7, "debug": 0.5}
COMPLEXITY_DEFAULT = 0.5
PEAK_HOURS = (20, 12, 2)


def token_cost(tier: Column | str, tin: Column | str, tout: Column | str, cache: Column | str,
               prices: Mapping[str, Mapping[str, float]] = PRICES, default: str = "opus") -> Column:
    """Cost of a token bundle; an unknown model is charged at the default tier."""
    tier = _c(tier)

    def price(kind: str) -> Column:
        out = F.when(tier == default, F.lit(prices[default].get(kind, 0.0)))
        for name, row in prices.items():
            if name != default:
                out = out.when(tier == name, F.lit(row.get(kind, 0.0)))
        return out.otherwise(F.lit(prices[default].get(kind, 0.0)))

    return (_c(tin) * price("input") + _c(tout) * price("output") + _c(cache) * price("cache")) / F.lit(1e6)


def outcome(messages: Column | str, tools: Column | str, has_error: Column) -> Column:
    m, t = _c(messages), _c(tools)
    return (F.when(has_error, F.lit("error")).when(m < 5, F.lit("abandoned"))
            .when((t > 10) | (m > 20), F.lit("success")).otherwise(F.lit("partial")))


def efficiency(calls: Mapping[str, Column]) -> Column:
    """Weighted mean over model calls; 0 without calls."""
    weighted = sum((calls[m] * F.lit(w) for m, w in EFFICIENCY_WEIGHTS.items()), F.lit(0.0))
    total = sum(calls.values(), F.lit(0))
    return rnd(weighted / F.greatest(total, F.lit(1)), 2)


def quality_estimate(messages: Column | str, tools: Column | str) -> Column:
    m, t = _c(messages) / F.lit(100.0), _c(tools) / F.lit(50.0)
    raw = F.lit(1.0) + F.least(F.lit(2.5), m) + F.least(F.lit(2.5), t)
    return rnd(clamp(raw, 1.0, 5.0), 1)


def fallback_quality(quality: Column | str, messages: Column | str) -> Column:
    """Recorded quality, else messages per 50 clamped to 1..5 (zero counts as missing)."""
    est = clamp(truthy_or(messages, F.lit(50)) / F.lit(50.0), 1.0, 5.0)
    return truthy_or(quality, est)


def fallback_complexity(complexity: Column | str, tools: Column | str) -> Column:
    return truthy_or(complexity, F.least(F.lit(1.0), truthy_or(tools, F.lit(10)) / F.lit(100.0)))


def query_complexity(text: Column | str) -> Column:
    return keyword_weight(text, COMPLEXITY_SIGNALS, COMPLEXITY_DEFAULT)


def recommended_tier(complexity: Column | str) -> Column:
    c = _c(complexity)
    return F.when(c >= 0.7, F.lit("opus")).when(c >= 0.4, F.lit("sonnet")).otherwise(F.lit("haiku"))


def routing_confidence(complexity: Column | str, hour: Column) -> Column:
    c = _c(complexity)
    base = F.when(c >= 0.7, F.lit(0.85)).when(c >= 0.4, F.lit(0.80)).otherwise(F.lit(0.75))
    return F.when(hour.isin(*PEAK_HOURS), F.least(base + F.lit(0.1), F.lit(0.95))).otherwise(base)


def complexity_band(c: Column | str, default: float = 0.5, cut: float = 0.6) -> Column:
    return F.when(F.coalesce(_c(c), F.lit(default)) > cut, F.lit("high")).otherwise(F.lit("low"))


def complexity_level(c: Column | str) -> Column:
    c = _c(c)
    return (F.when(c < 0.3, F.lit("low")).when(c < 0.6, F.lit("medium"))
            .when(c < 0.8, F.lit("high")).otherwise(F.lit("extreme")))


# Upper bounds of session sizes (inclusive) and of durations in seconds
# (exclusive), lower bounds of levels, success bands and write shares.
SIZES = ((0, "empty"), (5, "tiny"), (20, "small"), (50, "medium"), (100, "large"), (None, "marathon"))
DURATIONS = ((120, "<2m"), (300, "2-5m"), (600, "5-10m"), (1200, "10-20m"), (2400, "20-40m"), (None, "40m+"))
LEVELS = ((0.7, "surge"), (0.4, "active"), (0.2, "steady"), (None, "calm"))
BANDS = ((80, "good"), (50, "fair"), (None, "poor"))
WRITE_MODES = ((0.4, "High Output"), (0.25, "Balanced"), (0.1, "Research Heavy"), (None, "Exploration"))
READ_MODES = ((100, "Read-heavy (exploration mode)"), (20, "Learning/researching"), (10, "Balanced productivity"),
              (None, "High productivity mode"))
NO_FILES = "No activity"
ENERGY = ((0.7, "HIGH"), (0.5, "MED"), (None, "LOW"))
FLOW = 0.75
FRESH_MINUTES, STALE_MINUTES = 60, 1440


def _stepped(table: Sequence[tuple], test: Callable[[float], Column]) -> Column:
    """Text of the first step whose test holds; the last step has no bound and takes the rest, nulls too."""
    out = F.lit(table[-1][1])
    for bound, text in reversed(table[:-1]):
        out = F.when(test(bound), F.lit(text)).otherwise(out)
    return out


def size_bucket(messages: Column | str) -> Column:
    """Session size; an unknown message count falls in the last bucket."""
    m = _c(messages)
    return _stepped(SIZES, lambda b: m == b if b == 0 else m <= b)


def duration_bucket(seconds: Column | str) -> Column:
    s = _c(seconds)
    return _stepped(DURATIONS, lambda b: s < b)


def level(composite: Column | str) -> Column:
    c = _c(composite)
    return _stepped(LEVELS, lambda b: c >= b)


def in_flow(score: Column | str) -> Column:
    return F.coalesce(_c(score), F.lit(0.0)) >= FLOW


def freshness(age_minutes: Column | str) -> Column:
    a = _c(age_minutes)
    return (F.when((a >= 0) & (a <= FRESH_MINUTES), F.lit("fresh"))
            .when((a >= 0) & (a <= STALE_MINUTES), F.lit("stale")).otherwise(F.lit("offline")))


def effectiveness_band(rate: Column | str) -> Column:
    r = _c(rate)
    return _stepped(BANDS, lambda b: r >= b)


def write_mode(share: Column | str) -> Column:
    """Mode by the share of writes in file operations."""
    s = _c(share)
    return _stepped(WRITE_MODES, lambda b: s > b)


def read_write_mode(reads: Column, writes: Column) -> Column:
    ratio = reads / F.greatest(writes, F.lit(1))
    return F.when((reads == 0) & (writes == 0), F.lit(NO_FILES)).otherwise(_stepped(READ_MODES, lambda b: ratio > b))


# Parts of the day by their first and last hour (exclusive); the night is the rest.
DAY_PARTS = ((5, 9, "morning"), (9, 12, "peak"), (12, 14, "dip"), (14, 18, "peak"), (18, 22, "evening"))
NIGHT = "deep_night"


def day_mode(hour: Column | str) -> Column:
    h = _c(hour)
    out = F.lit(NIGHT)
    for first, last, part in DAY_PARTS:
        out = F.when((h >= first) & (h < last), F.lit(part)).otherwise(out)
    return out


# What suits each part of the day, and the tier recommended for it.
MODE_TASKS = {
    "morning": ("planning", "setup", "reviews"),
    "peak": ("architecture", "complex coding", "debugging"),
    "dip": ("documentation", "emails", "routine tasks"),
    "evening": ("creative work", "design", "exploration"),
    "deep_night": ("deep focus", "research", "refactoring"),
}
MODE_MODEL = {"morning": "sonnet", "peak": "opus", "dip": "haiku", "evening": "sonnet", "deep_night": "opus"}


def mode_model(mode: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in MODE_MODEL.items() for x in kv])
    return F.coalesce(lookup[mode], F.lit("sonnet"))


def mode_tasks(mode: Column) -> Column:
    """Array of tasks recommended in a mode."""
    out = F.array().cast("array<string>")
    for name, tasks in MODE_TASKS.items():
        out = F.when(mode == name, F.array(*[F.lit(t) for t in tasks])).otherwise(out)
    return out


def energy_label(energy: Column | str) -> Column:
    e = _c(energy)
    return _stepped(ENERGY, lambda b: e >= b)


# Texts of warnings and recommendations with the bounds that call for them.
LOW_ENERGY = (0.5, "Low energy day - consider lighter tasks")
DIP_WARNING = ("dip", "Post-lunch dip - avoid complex architecture")
TIER_ADVICE = (("CRITICAL", "Switch to Haiku for remaining tasks"), ("LOW", "Avoid Opus unless critical"))
LATE = (80, "Late in window - prioritize completion")
OVER_BUDGET = (85, "Budget pressure - consider model downgrade")
CROWDED = (5, "Batch similar tasks for efficiency")
HEALTHY = "Session healthy - proceed normally"
SUCCESS_ADVICE = ((0.5, "Consider waiting for a better hour or using a different model"),
                  (0.7, "Proceed with caution, break into smaller tasks"), (None, "Good conditions for this task"))


def day_warnings(energy: Column | str, mode: Column) -> Column:
    """Array of warnings for a day and mode."""
    return F.array_compact(F.array(
        F.when(_c(energy) < LOW_ENERGY[0], F.lit(LOW_ENERGY[1])), F.when(mode == DIP_WARNING[0], F.lit(DIP_WARNING[1]))))


def window_advice(tier: Column | str, position: Column | str, budget: Column | str, pending: Column | str) -> Column:
    """Recommendations for the current usage window, never empty."""
    t = _c(tier)
    by_tier = F.lit(None).cast("string")
    for name, text in TIER_ADVICE:
        by_tier = F.when(t == name, F.lit(text)).otherwise(by_tier)
    recs = F.array_compact(F.array(by_tier, *[
        F.when(_c(c) > bound, F.lit(text)) for c, (bound, text) in ((position, LATE), (budget, OVER_BUDGET), (pending, CROWDED))]))
    return F.when(F.size(recs) == 0, F.array(F.lit(HEALTHY))).otherwise(recs)


def success_advice(p: Column | str) -> Column:
    p = _c(p)
    return _stepped(SUCCESS_ADVICE, lambda b: p < b)
