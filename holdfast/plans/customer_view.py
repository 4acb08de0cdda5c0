"""One row per customer: demographics, latest subscription, revenue, engagement and support (v01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from holdfast.functions.business import is_cancelled, recognised
from holdfast.operators.customer_grain import engagement_by_customer, latest_subscription, support_by_customer
from holdfast.plans.customers import tenure_months
from holdfast.sources.tables import Tables


def customer_360(t: Tables) -> DataFrame:
    """Every fact is reduced to customer grain first; the left joins then share one partitioning.

    Totals and usage averages default to 0; satisfaction and last dates stay NULL. The last
    transaction date covers all transactions, recognised or not.
    """
    latest = latest_subscription(
        t.subscriptions, "plan_id", "billing_cycle", "monthly_price", "discount_percentage", "subscription_status",
        "cancellation_date", "cancellation_reason",
    )
    money = t.transactions.groupBy("customer_id").agg(
        F.sum(F.when(recognised(), F.col("amount"))).alias("total_revenue"),
        F.count_if(recognised()).alias("total_transactions"),
        F.max("transaction_date").alias("last_transaction_date"),
    )
    zero = F.lit(0)
    return (
        t.customers.join(latest, "customer_id", "left")
        .join(money, "customer_id", "left")
        .join(engagement_by_customer(t.activity), "customer_id", "left")
        .join(support_by_customer(t.tickets), "customer_id", "left")
        .join(t.plans.select("plan_id", "plan_name"), "plan_id", "left")
        .select(
            "customer_id", "signup_date", "age", "gender", "country", "region", "acquisition_channel",
            "plan_id", "plan_name", "billing_cycle", F.col("monthly_price").cast("double").alias("monthly_price"),
            "discount_percentage", "subscription_status", "cancellation_date", "cancellation_reason",
            F.coalesce("total_revenue", zero).cast("double").alias("total_revenue"),
            F.coalesce("total_transactions", zero).cast("long").alias("total_transactions"),
            "last_transaction_date",
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_sessions", "avg_session_minutes", "avg_feature_usage")],
            "last_activity_date",
            F.coalesce("n_tickets", zero).cast("long").alias("total_tickets"),
            "avg_satisfaction",
            F.coalesce("unresolved", zero).cast("long").alias("unresolved_tickets"),
            is_cancelled().alias("is_churned"),
            tenure_months(t).alias("tenure_months"),
        )
    )
