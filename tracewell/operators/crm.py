"""Contacts, deals and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.exprs import exact_sum
from tracewell.operators.joins import child_counts, lookup
from tracewell.operators.ordering import DEAL_STAGES, counter, ordinal_top, top


def _n():
    return F.count(F.lit(1))


def stats(contacts: DataFrame, deals: DataFrame, interactions: DataFrame, *, as_of: str, days: int = 7) -> DataFrame:
    """Contacts, deals, pipeline, interactions and follow-ups, as (metric, value)."""
    from tracewell.operators.daily import metric_rows
    horizon = F.date_add(F.lit(as_of).cast("date"), days).cast("string")
    open_deal = ~F.col("stage").isin("won", "lost")
    d = deals.agg(F.count_if(open_deal).alias("active_deals"),
                  F.coalesce(exact_sum(F.when(open_deal, F.col("value"))), F.lit(0.0)).alias("pipeline_value"),
                  F.count_if(F.col("stage") == "won").alias("won_deals"))
    i = interactions.agg(_n().alias("total_interactions"), F.count_if(
        F.col("follow_up").isNotNull() & (F.col("follow_up_date") <= horizon)).alias("follow_ups_due"))
    rows = metric_rows({"crm": contacts.agg(_n().alias("total_contacts"))}, {}).unionByName(
        metric_rows({"crm": d}, {})).unionByName(metric_rows({"crm": i}, {}))
    return rows.select("metric", "value")


def contact_activity(contacts: DataFrame, deals: DataFrame, interactions: DataFrame) -> DataFrame:
    """Deals and interactions per contact."""
    return child_counts(contacts, "id", {"deals": (deals, "contact_id"), "interactions": (interactions, "contact_id")})


def deals_with_contact(deals: DataFrame, contacts: DataFrame) -> DataFrame:
    return lookup(deals, contacts, "contact_id", "id", {"name": "contact_name"})


def deal_board(deals: DataFrame, contacts: DataFrame, n: int = 50) -> DataFrame:
    """Deals in pipeline order, newest first inside a stage, cut before the lookup."""
    cut = ordinal_top(deals, "stage", DEAL_STAGES, n, "-updated_at", "id")
    return lookup(cut, contacts, "contact_id", "id", {"name": "contact_name"})


def recent_interactions(interactions: DataFrame, contacts: DataFrame, n: int = 20) -> DataFrame:
    return lookup(top(interactions, n, "-created_at", "-id"), contacts, "contact_id", "id", {"name": "contact_name"})


def categories(contacts: DataFrame) -> DataFrame:
    return counter(contacts, "category", "category")
