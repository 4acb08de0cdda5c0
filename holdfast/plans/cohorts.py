"""Retention by start-month cohort, lifetime value and tenure (q35-q39, c01-c03).

Three retention definitions live side by side: latest status (q35), fixed days
without censoring (q36) and calendar months with immature cohorts left out (c01).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.functions.business import is_active
from holdfast.functions.scalars import dec_round, month_label, pct
from holdfast.operators.customer_grain import (
    latest_subscription, revenue_by_customer, subscription_order, subscription_span,
)
from holdfast.sources.tables import Tables

# Milestones in days and in calendar months.
MILESTONE_DAYS = {"m0_pct": 0, "m1_pct": 30, "m2_pct": 60, "m3_pct": 90, "m6_pct": 180, "m12_pct": 365}
MILESTONE_MONTHS = (0, 1, 2, 3, 6, 12)


def retention_by_cohort(t: Tables) -> DataFrame:
    """First start and latest status of each customer from a single aggregation."""
    people = t.subscriptions.groupBy("customer_id").agg(
        F.min("start_date").alias("first_start"),
        F.max_by("subscription_status", subscription_order()).alias("subscription_status"),
    )
    return (
        people.groupBy(month_label("first_start").alias("cohort_month"))
        .agg(F.count("*").alias("cohort_size"), F.sum(is_active()).alias("still_active"))
        .withColumn("retention_rate_pct", pct("still_active", "cohort_size"))
        .orderBy("cohort_month")
    )


def _kept(milestone: Column) -> Column:
    return F.col("churn_date").isNull() | (F.col("churn_date") >= milestone)


def cohort_milestones(t: Tables) -> DataFrame:
    kept = {
        name: F.count_if(_kept(F.date_add("first_start", days))) for name, days in MILESTONE_DAYS.items()
    }
    cohorts = (
        subscription_span(t.subscriptions).groupBy(month_label("first_start").alias("cohort_month"))
        .agg(F.count("*").alias("cohort_size"), *[n.alias(name) for name, n in kept.items()])
    )
    rates = [pct(name, "cohort_size", 1).alias(name) for name in kept]
    return cohorts.select("cohort_month", "cohort_size", *rates).orderBy("cohort_month")


def clv(t: Tables) -> DataFrame:
    paid = F.col("total_revenue")
    return revenue_by_customer(t.transactions).agg(
        dec_round(F.sum(paid).cast("double") / F.count("*")).alias("avg_clv"),
        F.min(paid).cast("double").alias("min_clv"),
        F.max(paid).cast("double").alias("max_clv"),
    )


def repeat_rate(t: Tables) -> DataFrame:
    per_customer = t.subscriptions.groupBy("customer_id").agg(F.count("*").alias("n"))
    return per_customer.agg(
        F.count("*").alias("total_customers"), F.count_if(F.col("n") > 1).alias("repeat_customers")
    ).withColumn("repeat_subscription_rate_pct", pct("repeat_customers", "total_customers"))


def avg_tenure_by_status(t: Tables) -> DataFrame:
    days = F.datediff(F.coalesce("end_date", F.lit(t.as_of)), F.col("start_date"))
    latest = latest_subscription(t.subscriptions, "subscription_status", "start_date", "end_date")
    return latest.groupBy("subscription_status").agg(dec_round(F.avg(days), 1).alias("avg_tenure_days"))


def cohort_long(t: Tables, milestones: Sequence[int] = MILESTONE_MONTHS) -> DataFrame:
    """(cohort_month, milestone, cohort_size, retained, retention_pct); a customer counts once it is old enough."""
    months = F.array(*[F.lit(m) for m in milestones])
    people = subscription_span(t.subscriptions).select(
        month_label("first_start").alias("cohort_month"), "first_start", "churn_date", F.explode(months).alias("m")
    )
    due = F.add_months("first_start", F.col("m"))
    return (
        people.where(due <= F.lit(t.as_of))
        .groupBy("cohort_month", F.concat(F.lit("M"), F.col("m").cast("string")).alias("milestone"))
        .agg(F.count("*").alias("cohort_size"), F.count_if(_kept(due)).alias("retained"))
        .withColumn("retention_pct", pct("retained", "cohort_size", 1))
    )


def cohort_matrix(t: Tables, milestones: Sequence[int] = MILESTONE_MONTHS) -> DataFrame:
    """Cohorts by milestones, NULL where nobody is old enough. Fixed columns, so no extra job finds them."""
    names = [f"M{m}" for m in milestones]
    return (
        cohort_long(t, milestones).groupBy("cohort_month").pivot("milestone", names).agg(F.first("retention_pct"))
        .orderBy("cohort_month")
    )


def cohort_trend(t: Tables) -> DataFrame:
    """Mean M3 retention of the earlier against the later half of the cohorts."""
    m3 = cohort_long(t, (3,)).select("cohort_month", "retention_pct")
    # one row per cohort month
    place = F.row_number().over(Window.orderBy("cohort_month"))
    half = F.floor(F.count("*").over(Window.partitionBy()) / 2)
    halves = m3.withColumn("early", place <= half)
    return halves.agg(
        dec_round(F.avg(F.when(F.col("early"), F.col("retention_pct"))), 1).alias("early_avg_m3"),
        dec_round(F.avg(F.when(~F.col("early"), F.col("retention_pct"))), 1).alias("late_avg_m3"),
        F.avg(F.when(F.col("early"), F.col("retention_pct"))).alias("a"),
        F.avg(F.when(~F.col("early"), F.col("retention_pct"))).alias("b"),
    ).select(
        "early_avg_m3", "late_avg_m3",
        F.when(F.col("b") > F.col("a"), "improving").when(F.col("b") < F.col("a"), "declining")
        .when(F.col("a").isNotNull(), "flat").alias("trend"),
    )
