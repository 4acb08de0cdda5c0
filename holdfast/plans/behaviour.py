"""How churned and active customers use the product (q29-q34)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from holdfast.functions.business import ACTIVE
from holdfast.functions.scalars import dec_round
from holdfast.operators.customer_grain import (
    engagement_by_customer, latest_subscription, revenue_by_customer, support_by_customer,
)
from holdfast.operators.ranking import ntile_exact
from holdfast.sources.tables import Tables

# The two comparison windows as day offsets before the observation date, and the decline factor.
RECENT_DAYS = 31
PRIOR_DAYS = 92
DECLINE_FACTOR = 0.6


def _usage_by_status(t: Tables, measure: str, name: str) -> DataFrame:
    """Mean over customers of their own mean."""
    usage = engagement_by_customer(t.activity).select("customer_id", measure)
    joined = latest_subscription(t.subscriptions, "subscription_status").join(usage, "customer_id")
    return joined.groupBy("subscription_status").agg(dec_round(F.avg(measure)).alias(name))


def sessions_by_status(t: Tables) -> DataFrame:
    return _usage_by_status(t, "avg_sessions", "avg_sessions_per_customer")


def minutes_by_status(t: Tables) -> DataFrame:
    return _usage_by_status(t, "avg_session_minutes", "avg_session_minutes")


def features_by_status(t: Tables) -> DataFrame:
    return _usage_by_status(t, "avg_feature_usage", "avg_feature_usage")


def tickets_by_status(t: Tables) -> DataFrame:
    joined = latest_subscription(t.subscriptions, "subscription_status").join(
        support_by_customer(t.tickets), "customer_id", "left"
    )
    return joined.groupBy("subscription_status").agg(
        dec_round(F.avg(F.coalesce("n_tickets", F.lit(0)))).alias("avg_tickets"),
        dec_round(F.avg("avg_satisfaction")).alias("avg_satisfaction"),
    )


def engagement_windows(t: Tables, recent_days: int = RECENT_DAYS, prior_days: int = PRIOR_DAYS) -> DataFrame:
    """Mean sessions in the recent and the prior window, both from one pass; both must have data."""
    recent_from = t.as_of - dt.timedelta(days=recent_days)
    prior_from = t.as_of - dt.timedelta(days=prior_days)
    day = F.col("activity_date")
    return (
        t.activity.where(day >= F.lit(prior_from)).groupBy("customer_id")
        .agg(
            F.avg(F.when(day >= F.lit(recent_from), F.col("sessions"))).alias("recent_avg"),
            F.avg(F.when(day < F.lit(recent_from), F.col("sessions"))).alias("prior_avg"),
        )
        .where(F.col("recent_avg").isNotNull() & F.col("prior_avg").isNotNull())
    )


def declining_customers(t: Tables) -> DataFrame:
    """customer_id of active customers whose sessions fell below the decline factor."""
    falling = engagement_windows(t).where(F.col("recent_avg") < DECLINE_FACTOR * F.col("prior_avg"))
    active = latest_subscription(t.subscriptions, "subscription_status").where(F.col("subscription_status") == ACTIVE)
    return active.join(falling, "customer_id").select("customer_id")


def declining_engagement(t: Tables) -> DataFrame:
    return declining_customers(t).agg(F.count("*").alias("declining_engagement_customers"))


def revenue_quartiles(t: Tables) -> DataFrame:
    """(customer_id, total_revenue, quartile) of customers with revenue; 4 is the highest."""
    paid = revenue_by_customer(t.transactions).select("customer_id", "total_revenue")
    return ntile_exact(paid, "total_revenue", "customer_id", 4, "quartile")


def high_value_declining(t: Tables) -> DataFrame:
    top = revenue_quartiles(t).where(F.col("quartile") == 4)
    return top.join(declining_customers(t), "customer_id").agg(
        F.count("*").alias("high_value_declining_customers"),
        F.sum("total_revenue").cast("double").alias("revenue_represented"),
    )
