"""Data quality, freshness, growth and advice over datasets and runs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.exprs import age_label, count_if, day_of, exact_sum, fixed, mean, pct, rnd
from tracewell.functions.scoring import freshness

# Share of bad lines that raises a warning, and the smallest link table.
MAX_ERROR_RATE = 0.05
MIN_ROWS = 1000


def dataset_freshness(datasets: Mapping[str, tuple[DataFrame, str, float]], *, as_of: int) -> DataFrame:
    """Newest event, age and verdict per dataset: ``{name: (rows, ts column, max age hours)}``."""
    parts = []
    for name, (df, ts, max_hours) in datasets.items():
        parts.append(df.agg(F.max(ts).alias("latest")).select(
            F.lit(name).alias("name"), F.lit(float(max_hours)).alias("max_hours"),
            ((F.lit(as_of) - F.col("latest")) / F.lit(3600.0)).alias("_age")))
    rows = reduce(DataFrame.unionByName, parts)
    known = F.col("_age").isNotNull()
    return rows.select(
        "name", "max_hours", F.coalesce(rnd("_age", 2), F.lit(-1.0)).alias("hours"),
        F.when(known, age_label("_age")).otherwise(F.lit("Missing")).alias("age"),
        F.when(~known, F.lit("error")).when(F.col("_age") <= F.col("max_hours"), F.lit("ok"))
        .otherwise(F.lit("warn")).alias("status"))


def stream_freshness(df: DataFrame, ts: str, *, as_of: int) -> DataFrame:
    """Minutes since the newest event (-1 when empty) and the gauge label."""
    age = F.coalesce(rnd((F.lit(as_of) - F.max(ts)) / F.lit(60.0), 1), F.lit(-1.0))
    return df.agg(age.alias("age_minutes")).withColumn("freshness", freshness("age_minutes"))


def jsonl_health(lines: DataFrame, text: str = "line", *, max_rate: float = MAX_ERROR_RATE) -> DataFrame:
    """Valid and invalid lines, error rate and verdict; blank lines are ignored."""
    rows = lines.filter(F.trim(text) != "")
    good = F.try_parse_json(text).isNotNull()
    t = rows.agg(count_if(good).alias("valid"), count_if(~good).alias("invalid"))
    rate = F.coalesce(F.try_divide(F.col("invalid").cast("double"), (F.col("valid") + F.col("invalid")).cast("double")),
                      F.lit(0.0))
    return t.select("valid", "invalid", rnd(rate * 100, 1).alias("error_pct"),
                    F.when(rate < max_rate, F.lit("ok")).otherwise(F.lit("warn")).alias("status"))


def min_rows(tables: Mapping[str, DataFrame], threshold: int = MIN_ROWS) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).withColumn(
        "status", F.when(F.col("rows") >= threshold, F.lit("ok")).otherwise(F.lit("warn")))


def check_report(checks: DataFrame) -> DataFrame:
    """Checks by category and status, with the verdict of the category; ``*`` is the total."""
    cells = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "error")]
    per = checks.groupBy("category").agg(*cells)
    whole = per.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("ok", "warn", "error")])
    rows = per.unionByName(whole.select(F.lit("*").alias("category"), "ok", "warn", "error"))
    verdict = (F.when((F.col("error") == 0) & (F.col("warn") == 0), F.lit("HEALTHY"))
               .when(F.col("error") == 0, F.lit("DEGRADED")).otherwise(F.lit("UNHEALTHY")))
    return rows.select("*", (F.col("ok") + F.col("warn") + F.col("error")).alias("total"), verdict.alias("verdict"))


def growth_alerts(daily_rows: DataFrame, *, max_per_day: float) -> DataFrame:
    """Datasets whose size per day of age exceeds the limit.

    ``daily_rows`` is (name, date, size), a row per dataset and day.
    """
    age = F.greatest(F.datediff(F.max(F.col("date").cast("date")), F.min(F.col("date").cast("date"))), F.lit(1))
    t = daily_rows.groupBy("name").agg(F.sum("size").alias("size"), age.cast("bigint").alias("age_days"))
    rate = F.col("size").cast("double") / F.col("age_days")
    return t.select("name", "size", "age_days", rate.alias("per_day")).filter(F.col("per_day") > max_per_day)


def threshold_advice(runs: DataFrame, last_n: int | None = None, min_runs: int = 10) -> DataFrame:
    """Advice from the share of runs with fixes, among the newest ``last_n`` if given."""
    from tracewell.operators.ordering import latest
    t = (runs if last_n is None else latest(runs, "ts", last_n)).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("fixed") > 0).alias("fixing"))
    rate = F.try_divide(F.col("fixing").cast("double"), F.col("runs").cast("double"))
    advice = (F.when(F.col("runs") < min_runs, F.lit("none")).when(rate > 0.8, F.lit("tighten_thresholds"))
              .when(rate < 0.1, F.lit("loosen_thresholds")).otherwise(F.lit("none")))
    return t.select("runs", "fixing", F.coalesce(rate, F.lit(0.0)).alias("fix_rate"), advice.alias("suggestion"))


def anomalies(runs: DataFrame, *, baseline: float, k: float = 3.0, tz: str = "UTC") -> DataFrame:
    """Days whose fixes exceed ``k`` times the baseline."""
    daily = runs.groupBy(day_of("ts", tz).alias("date")).agg(F.sum("fixed").alias("value"))
    return daily.filter(F.col("value") > baseline * k).select(
        "date", "value", F.lit(float(baseline)).alias("baseline"), F.lit("warning").alias("severity"))


def compare_snapshots(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Health score (ok / total) before and after a change: keep it or roll back."""
    both = before.select(key, "ok", "total", F.lit(0).alias("_side")).unionByName(
        after.select(key, "ok", "total", F.lit(1).alias("_side")))

    def score(side: int) -> Column:
        part = [F.sum(F.when(F.col("_side") == side, F.col(c))).cast("double") for c in ("ok", "total")]
        return F.coalesce(F.try_divide(*part), F.lit(0.0))

    joined = both.groupBy(key).agg(score(0).alias("baseline"), score(1).alias("after"))
    gain = F.col("after") - F.col("baseline")
    return joined.select("*", gain.alias("improvement"),
                         F.when(gain >= 0, F.lit("applied")).otherwise(F.lit("rolled_back")).alias("status"))


def issue_predictions(risky: DataFrame, growth: DataFrame, hour: int) -> DataFrame:
    """Predicted issues from several rules in one shape.

    ``risky`` is (hour, n) from the run history, compared as integers.
    """
    time_risk = risky.filter(F.col("hour") == hour).select(
        F.lit("time_risk").alias("type"), F.lit(0.7).alias("confidence"),
        F.concat(F.lit("Hour "), F.col("hour").cast("string"), F.lit(" historically has issues")).alias("message"),
        F.lit("preemptive_check").alias("action"))
    grows = growth.select(
        F.lit("log_growth").alias("type"), F.lit(0.8).alias("confidence"),
        F.concat(F.col("name"), F.lit(" growing at "), fixed(F.col("per_day"), 1), F.lit(" per day")).alias("message"),
        F.lit("schedule_rotation").alias("action"))
    return time_risk.unionByName(grows)


# ---- spend -----------------------------------------------------------------

def spend_baseline(costs: DataFrame, *, as_of: int, tz: str = "UTC", default: float = 200.0) -> DataFrame:
    """Mean daily spend (a default without data) and the spend of the day of ``as_of``."""
    today = day_of(F.lit(as_of), tz)
    daily = costs.groupBy(day_of("ts", tz).alias("_d")).agg(exact_sum("cost_usd").alias("_c"))
    return daily.agg(F.coalesce(mean("_c"), F.lit(default)).alias("baseline"),
                     F.coalesce(exact_sum(F.when(F.col("_d") == today, F.col("_c"))), F.lit(0.0)).alias("today"))


def forecast_day(spend: DataFrame, *, hours_elapsed: float) -> DataFrame:
    """End-of-day spend at the current hourly rate, with status and action."""
    if hours_elapsed > 0:
        predicted: Column = F.col("today") + F.col("today") / F.lit(hours_elapsed) * F.lit(24.0 - hours_elapsed)
    else:
        predicted = F.col("baseline")
    p = rnd(predicted, 2)
    action = (F.when(p > 300, F.lit("Switch to Sonnet/Haiku for remaining tasks"))
              .when(p > F.col("baseline") * 1.3, F.lit("Consider batching remaining requests"))
              .otherwise(F.lit("On track")))
    return spend.select("today", p.alias("predicted"), "baseline", F.when(p > F.col("baseline") * 1.5, F.lit("warning"))
                        .otherwise(F.lit("ok")).alias("status"), action.alias("action"))


def advice(cases: DataFrame, spend: DataFrame, timing_score: float) -> DataFrame:
    """One recommendation per case from success, cost and timing.

    ``cases`` carries model, confidence, success_probability and advice; ``spend``
    is the one-row forecast.
    """
    cost_status = spend.select("status").scalar()
    issues = F.array_compact(F.array(
        F.when(F.col("success_probability") < 0.5, F.lit("low success probability")),
        F.when(cost_status == "warning", F.lit("cost trending high")),
        F.when(F.lit(timing_score) < 0.5, F.lit("suboptimal hour"))))
    fine = F.concat(F.lit("Proceed with "), F.col("model"), F.lit(" (confidence: "),
                    fixed(F.col("confidence") * 100, 0), F.lit("%)"))
    text = F.when(F.size(issues) == 0, fine).otherwise(
        F.concat(F.lit("Caution: "), F.array_join(issues, ", "), F.lit(". Consider: "), F.col("advice")))
    return cases.withColumn("recommendation", text)


def health_pct(ok: Column, total: Column) -> Column:
    return F.coalesce(pct(ok, total), F.lit(0.0))
