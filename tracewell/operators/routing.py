"""Routing decisions, expertise routing and prediction accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.exprs import (
    MILLIS_CUTOFF, MODEL_TIERS, day_of, exact_total, falsy, mean, pct, rnd)
from tracewell.functions.scoring import RELATIVE_COST, complexity_level
from tracewell.operators.filters import within_days
from tracewell.operators.joins import most_frequent
from tracewell.operators.ordering import recent_ascending


def _n() -> Column:
    return F.count(F.lit(1))


def stats(decisions: DataFrame, *, as_of: int, days: int = 7) -> DataFrame:
    """Decisions, mean score and count per tier in the window."""
    return decisions.filter(F.col("timestamp") >= as_of - days * 86400).agg(
        _n().alias("total"), mean("dq_score").alias("avg_dq"),
        *[F.count_if(F.col("selected_model") == m).alias(f"{m}_count") for m in MODEL_TIERS])


def nonzero_dq(decisions: DataFrame) -> DataFrame:
    """Mean over non-zero scores; zero scores leave both the mean and the total."""
    scored = decisions.filter(~falsy("dq_score"))
    return scored.agg(_n().alias("total"), F.coalesce(mean("dq_score"), F.lit(0.0)).alias("avg_dq"))


def daily_trend(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(day_of("timestamp").alias("date")).agg(
        _n().alias("queries"), rnd(mean("dq_score"), 3).alias("avg_dq"),
        rnd(mean("complexity"), 3).alias("avg_complexity"),
        *[F.count_if(F.col("selected_model") == m).alias(m) for m in MODEL_TIERS]).orderBy("date")


def recent_trend(decisions: DataFrame, n: int = 30) -> DataFrame:
    """The newest ``n`` days, oldest first."""
    return recent_ascending(daily_trend(decisions).select("date", "queries", "avg_dq", "avg_complexity"), "date", n)


def dq_components(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("dq_validity").isNotNull()).agg(*[
        F.coalesce(rnd(mean(f"dq_{c}"), 3), F.lit(0.0)).alias(c) for c in ("validity", "specificity", "correctness")])


def complexity_by_model(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("complexity").isNotNull()).groupBy("selected_model").agg(
        rnd(F.min("complexity"), 3).alias("min"), rnd(mean("complexity"), 3).alias("avg"),
        rnd(F.max("complexity"), 3).alias("max"), _n().alias("n"))


def model_success(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("model_used").isNotNull()).groupBy("model_used").agg(
        _n().alias("total"), pct(F.count_if(F.col("outcome") == "success"), _n()).alias("success_rate"))


def pooled_accuracy(outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Success over all outcomes, or the mean score in percent when there are none."""
    o = outcomes.filter(F.col("model_used").isNotNull()).agg(
        _n().alias("total"), F.count_if(F.col("outcome") == "success").alias("ok"), F.lit(None).cast("double").alias("dq"))
    d = nonzero_dq(decisions).select(F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("ok"),
                                     F.col("avg_dq").alias("dq"))
    both = o.unionByName(d).agg(F.max("total").alias("total"), F.max("ok").alias("ok"), F.max("dq").alias("dq"))
    return both.select(F.col("total").alias("feedback_count"), F.coalesce(
        pct(F.col("ok"), F.col("total")), rnd(F.col("dq") * 100, 1)).alias("accuracy"))


def model_share(decisions: DataFrame, col: str = "selected_model") -> DataFrame:
    """Count and share (3 decimals) per model."""
    counts = decisions.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("model")).agg(_n().alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row per model
    return counts.select("model", "n", rnd(F.col("n").cast("double") / total, 3).alias("share"))


def routing_saving(shares: DataFrame) -> DataFrame:
    """Saving against sending everything to the largest model, in percent."""
    s = shares.agg(*[F.coalesce(F.sum(F.when(F.col("model") == m, F.col("share"))), F.lit(0.0)).alias(f"_{m}")
                     for m in MODEL_TIERS])
    used = F.col("_haiku") * RELATIVE_COST["haiku"] + F.col("_sonnet") * RELATIVE_COST["sonnet"] + F.col("_opus")
    return s.select(F.when(F.col("_opus") < 1, rnd((F.lit(1.0) - used) * 100, 1)).otherwise(F.lit(0.0))
                    .alias("cost_reduction"))


def targets_met(accuracy: DataFrame, saving: DataFrame, dq: DataFrame, *, latency_ms: float | None,
                accuracy_target: float = 60.0, saving_target: float = 20.0, latency_target: float = 50.0,
                dq_target: float = 0.80) -> DataFrame:
    """How many of four targets hold. An unmeasured latency (None) is not met."""
    rows = (accuracy.select(F.lit("accuracy").alias("target"), (F.col("accuracy") >= accuracy_target).alias("ok"))
            .unionByName(saving.select(F.lit("cost").alias("target"),
                                       (F.col("cost_reduction") >= saving_target).alias("ok")))
            .unionByName(dq.select(F.lit("dq").alias("target"), (F.col("avg_dq") >= dq_target).alias("ok"))))
    fast = latency_ms is not None and 0 < latency_ms < latency_target
    met = F.count_if(F.coalesce("ok", F.lit(False))) + F.lit(int(fast))
    return rows.agg(met.cast("bigint").alias("targets_met"), F.lit(4).cast("bigint").alias("targets"))


def accuracy_view(decisions: DataFrame) -> DataFrame:
    """Per model: successes, failures, mean score, accuracy over rated decisions."""
    ok = F.count_if(F.col("success") == 1)
    return decisions.groupBy("selected_model").agg(
        _n().alias("total_decisions"), ok.alias("successes"), F.count_if(F.col("success") == 0).alias("failures"),
        rnd(mean("dq_score"), 3).alias("avg_dq_score"), pct(ok, F.count("success")).alias("accuracy_pct"))


def mean_quality_by_model(outcomes: DataFrame, last_n: int | None = None) -> DataFrame:
    from tracewell.operators.ordering import tail
    return tail(outcomes, "timestamp", last_n).groupBy(F.coalesce("model_used", F.lit("unknown")).alias("model")).agg(
        mean(F.coalesce("quality_score", F.lit(3.0))).alias("quality"))


# ---- expertise -------------------------------------------------------------

def _levels() -> list[Column]:
    return [rnd(mean("expertise_level"), 2).alias("avg_expertise"),
            rnd(mean("query_complexity"), 2).alias("avg_complexity")]


def _domain_models(events: DataFrame) -> DataFrame:
    """Counts and sums per (domain, model): a few rows, built by a hash aggregate."""
    return events.groupBy("domain", "chosen_model").agg(
        _n().alias("n"), exact_total("expertise_level").alias("e"), F.count("expertise_level").alias("en"),
        exact_total("query_complexity").alias("c"), F.count("query_complexity").alias("cn"))


def _folded_levels(digits: int) -> list[Column]:
    return [rnd(F.try_divide(F.sum("e").cast("double"), F.sum("en")), digits).alias("avg_expertise"),
            rnd(F.try_divide(F.sum("c").cast("double"), F.sum("cn")), digits).alias("avg_complexity")]


def expertise_domains(events: DataFrame) -> DataFrame:
    """Per domain: count, means and the most frequent model (ties by name)."""
    return _domain_models(events).groupBy("domain").agg(
        F.sum("n").alias("n"), *_folded_levels(3),
        F.min_by("chosen_model", F.struct(-F.col("n"), "chosen_model")).alias("primary_model"))


def expertise_heatmap(events: DataFrame, *, as_of: int, days: int = 30) -> DataFrame:
    return within_days(events, "timestamp", days, as_of=as_of).groupBy(
        "domain", F.col("chosen_model").alias("model")).agg(_n().alias("n"), *_levels())


def expertise_summary(events: DataFrame, *, as_of: int, days: int = 30) -> DataFrame:
    """Per domain: queries, means and the sorted list of models used."""
    return _domain_models(within_days(events, "timestamp", days, as_of=as_of)).groupBy("domain").agg(
        F.sum("n").alias("total_queries"), *_folded_levels(2),
        F.array_join(F.sort_array(F.collect_set("chosen_model")), ",").alias("models_used"))


def expertise_totals(events: DataFrame, *, as_of: int, days: int = 30) -> DataFrame:
    return within_days(events, "timestamp", days, as_of=as_of).agg(
        _n().alias("total_events"), F.count_distinct("domain").alias("unique_domains"), *_levels())


def complexity_levels(events: DataFrame, *, as_of: int, days: int = 30) -> DataFrame:
    return within_days(events, "timestamp", days, as_of=as_of).groupBy(
        complexity_level("query_complexity").alias("level"), F.col("chosen_model").alias("model")).agg(_n().alias("n"))


def log_avg_dq(log: DataFrame, *, as_of: int, days: int = 30, default: float = 0.75) -> DataFrame:
    """Mean positive score of the score log, whose fields and units vary."""
    ts = F.when(F.col("ts") > MILLIS_CUTOFF, F.col("ts") / 1000).otherwise(F.col("ts"))
    dq = F.coalesce("dqScore", "dq", "dq_obj_score", F.lit(0.0))
    recent = log.filter((ts > as_of - days * 86400) & (dq > 0))
    return recent.agg(F.coalesce(mean(dq), F.lit(default)).alias("avg_dq"))


# ---- predictions -----------------------------------------------------------

PREDICTED = ("success", "abandon", "partial")


def prediction_accuracy(predictions: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("correct") == 1)
    return predictions.agg(_n().alias("total"), ok.alias("correct"),
                           F.coalesce(pct(ok, _n()), F.lit(0.0)).alias("accuracy"))


def prediction_distribution(predictions: DataFrame) -> DataFrame:
    """Predictions per class; anything unexpected counts as unknown."""
    label = F.when(F.col("predicted").isin(*PREDICTED), F.col("predicted")).otherwise(F.lit("unknown"))
    return predictions.groupBy(label.alias("predicted")).agg(_n().alias("n"))


def prediction_daily(predictions: DataFrame, n: int = 30) -> DataFrame:
    ok = F.count_if(F.col("correct") == 1)
    daily = predictions.groupBy(day_of("timestamp").alias("date")).agg(
        _n().alias("total"), ok.alias("correct"), pct(ok, _n()).alias("accuracy"))
    return recent_ascending(daily, "date", n)


def collapse_other(df: DataFrame, col: str, keep: Sequence[str], other: str = "Other") -> DataFrame:
    """Counts with all values outside ``keep`` merged into one bucket."""
    label = F.when(F.col(col).isin(*keep), F.col(col)).otherwise(F.lit(other))
    return df.filter(F.col(col).isNotNull()).groupBy(label.alias("value")).agg(_n().alias("n"))


def primary_model(events: DataFrame) -> DataFrame:
    return most_frequent(events, "domain", "chosen_model")


def parse_log_entry_score(entry: Column) -> Column:
    """Score of a JSON log entry: ``dqScore``, else ``dq`` as number or as object."""
    v = F.try_parse_json(entry)
    return F.coalesce(F.try_variant_get(v, "$.dqScore", "double"), F.try_variant_get(v, "$.dq", "double"),
                      F.try_variant_get(v, "$.dq.score", "double"), F.lit(0.0))
