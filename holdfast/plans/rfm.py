"""Recency, frequency, monetary scores and the segments built on them (r01-r04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.business import CANCELLED, is_cancelled
from holdfast.functions.scalars import pct
from holdfast.operators.customer_grain import latest_subscription, revenue_by_customer
from holdfast.operators.ranking import qcut_label
from holdfast.operators.rates import share_of_total
from holdfast.operators.stable import stable
from holdfast.sources.tables import Tables

# Recency of a customer that never paid, and the number of score classes.
NEVER_PAID_DAYS = 9999
CLASSES = 5


def rfm_base(t: Tables) -> DataFrame:
    """All customers, paying or not, with their latest status."""
    paid = revenue_by_customer(t.transactions)
    latest = latest_subscription(t.subscriptions, "subscription_status")
    return (
        t.customers.select("customer_id").join(paid, "customer_id", "left").join(latest, "customer_id", "left")
        .select(
            "customer_id",
            F.coalesce(F.datediff(F.lit(t.as_of), "last_charge"), F.lit(NEVER_PAID_DAYS)).alias("recency_days"),
            F.coalesce("charges", F.lit(0)).cast("long").alias("frequency"),
            F.coalesce("total_revenue", F.lit(0)).cast("decimal(28,2)").alias("monetary"),
            "subscription_status",
        )
    )


def segment_expr(r: Column, f: Column, m: Column, status: Column) -> Column:
    """First matching rule wins. Segment names and score limits."""
    return (
        F.when((status == CANCELLED) & (r <= 2), "Lost")
        .when((r <= 2) & (F.least(f, m) <= 2), "Dormant")
        .when(r <= 2, "At Risk")
        .when(F.least(r, f, m) >= 4, "VIP")
        .when(F.least(r, f, m) >= 3, "Loyal")
        .when((r >= 4) & (f <= 2), "New")
        .otherwise("Potential Loyal")
    )


def _scored(t: Tables) -> DataFrame:
    # three rankings read the base, so it is written once
    base = stable(rfm_base(t))
    measures = {"R_score": "recency_days", "F_score": "frequency", "M_score": "monetary"}
    scores = base.withColumns({name: qcut_label(base, value, "customer_id", CLASSES) for name, value in measures.items()})
    return scores.withColumn("R_score", CLASSES + 1 - F.col("R_score"))


def rfm(t: Tables) -> DataFrame:
    """Scores 1 (worst) to 5, their sum and the segment; a short recency scores high."""
    r, f, m = F.col("R_score"), F.col("F_score"), F.col("M_score")
    return _scored(t).withColumns({
        "rfm_score": r + f + m, "segment": segment_expr(r, f, m, F.col("subscription_status")),
    })


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("monetary", F.col("monetary").cast("double"))


def rfm_base_report(t: Tables) -> DataFrame:
    return _plain(rfm_base(t))


def rfm_scores(t: Tables) -> DataFrame:
    return rfm(t).select("customer_id", "R_score", "F_score", "M_score", "rfm_score")


def rfm_segments(t: Tables) -> DataFrame:
    return _plain(rfm(t))


def segment_summary(t: Tables) -> DataFrame:
    per_segment = rfm(t).groupBy("segment").agg(
        F.count("*").alias("customers"), F.sum("monetary").alias("total_revenue"), F.sum(is_cancelled()).alias("gone")
    )
    shares = share_of_total(
        share_of_total(per_segment, "customers", "pct_of_customers"), "total_revenue", "pct_of_revenue"
    )
    return shares.select(
        "segment", "customers", F.col("total_revenue").cast("double").alias("total_revenue"),
        pct("gone", "customers").alias("churn_rate"), "pct_of_customers", "pct_of_revenue",
    ).orderBy(F.desc("total_revenue"))
