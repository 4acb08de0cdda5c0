"""Facts reduced to one row per customer before anything is joined.

Each is one shuffle on customer_id of map-side partial results, so a customer
that owns a third of a fact table still reaches the shuffle as one row per map
task, and the joins that follow reuse the customer_id partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.business import CANCELLED, UNRESOLVED, recognised


def subscription_order() -> Column:
    """Ties on start_date go to the higher subscription_id."""
    return F.struct("start_date", "subscription_id")


def latest_subscription(subs: DataFrame, *columns: str) -> DataFrame:
    """The most recent subscription of each customer; the whole row unless columns are named."""
    kept = [c for c in (columns or subs.columns) if c != "customer_id"]
    return (
        subs.groupBy("customer_id").agg(F.max_by(F.struct(*kept), subscription_order()).alias("latest"))
        .select("customer_id", "latest.*")
    )


def subscription_span(subs: DataFrame) -> DataFrame:
    """First start and earliest cancellation per customer."""
    return subs.groupBy("customer_id").agg(
        F.min("start_date").alias("first_start"),
        F.min(F.when(F.col("subscription_status") == CANCELLED, F.col("cancellation_date"))).alias("churn_date"),
    )


def revenue_by_customer(txns: DataFrame) -> DataFrame:
    """Recognised revenue; only customers that have some."""
    return (
        txns.where(recognised()).groupBy("customer_id")
        .agg(
            F.sum("amount").alias("total_revenue"),
            F.count("*").alias("charges"),
            F.max("transaction_date").alias("last_charge"),
        )
    )


def engagement_by_customer(activity: DataFrame) -> DataFrame:
    return activity.groupBy("customer_id").agg(
        F.avg("sessions").alias("avg_sessions"),
        F.avg("session_minutes").alias("avg_session_minutes"),
        F.avg("feature_usage_count").alias("avg_feature_usage"),
        F.max("activity_date").alias("last_activity_date"),
    )


def support_by_customer(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("customer_id").agg(
        F.count("*").alias("n_tickets"),
        F.avg("satisfaction_score").alias("avg_satisfaction"),
        F.sum(F.when(F.col("ticket_status") == UNRESOLVED, 1).otherwise(0)).alias("unresolved"),
    )
