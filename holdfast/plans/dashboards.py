"""Feeds of the dashboard pages that no other report covers (d01-d09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from holdfast.functions.bands import bands_left
from holdfast.functions.business import CANCELLED, PRIORITY_LABELS, annualised, is_cancelled
from holdfast.functions.scalars import dec_round, month_label, month_start, pct
from holdfast.operators.customer_grain import latest_subscription
from holdfast.operators.histogram import histogram
from holdfast.operators.timeline import by_month, fill_months, running
from holdfast.plans import churn_model
from holdfast.plans.churn import AGE_CUTS, AGE_LABELS
from holdfast.plans.customers import tenure_months
from holdfast.plans.exploration import customer_growth, customer_status
from holdfast.plans.rfm import segment_summary
from holdfast.sources.tables import Tables

FINDING_DIMENSIONS = ("plan_name", "billing_cycle", "region", "acquisition_channel", "age_group")


def cumulative_customers(t: Tables) -> DataFrame:
    return customer_growth(t).select("month", F.col("cumulative").alias("customers"))


def _subscription_months(t: Tables) -> DataFrame:
    """(month, starts, cancellations, started_so_far, cancelled_so_far), gaps filled; one scan of subscriptions."""
    events = F.array(
        F.struct(F.col("start_date").alias("day"), F.lit(1).alias("s"), F.lit(0).alias("c")),
        F.struct(F.when(is_cancelled() == 1, F.col("cancellation_date")).alias("day"), F.lit(0).alias("s"), F.lit(1).alias("c")),
    )
    monthly = by_month(t.subscriptions.select(F.inline(events)), "day", starts=F.sum("s"), cancellations=F.sum("c"))
    filled = fill_months(monthly, "starts", "cancellations")
    return running(running(filled, "starts", "started_so_far"), "cancellations", "cancelled_so_far")


def churn_combo(t: Tables) -> DataFrame:
    """Cancellations of each month, and their share of the subscriptions started so far."""
    return _subscription_months(t).select(
        "month", "cancellations", pct("cancellations", "started_so_far", 3).alias("churn_rate_pct")
    ).orderBy("month")


def retention_trend(t: Tables) -> DataFrame:
    """Share of the subscriptions started so far that are not cancelled by the end of the month."""
    return _subscription_months(t).select(
        "month", pct(F.col("started_so_far") - F.col("cancelled_so_far"), "started_so_far", 3).alias("retention_rate_pct")
    ).orderBy("month")


def mrr_trend(t: Tables) -> DataFrame:
    """Recurring revenue of the subscriptions running at each month end.

    A start adds its price in its month and an end takes it away in its own, so a running sum over months
    replaces the join of every subscription with every month it spans.
    """
    annual = F.col("billing_cycle") == "Annual"
    price, zero = F.col("monthly_price"), F.lit(0).cast("decimal(8,2)")
    step = lambda day, sign: F.struct(
        month_start(day).alias("month"),
        (F.when(annual, zero).otherwise(price) * sign).alias("m"), (F.when(annual, price).otherwise(zero) * sign).alias("a"),
    )
    steps = t.subscriptions.select(F.inline(F.array(step("start_date", 1), step("end_date", -1))))
    monthly = (
        steps.where(F.col("month").isNotNull() & (F.col("month") <= F.lit(t.as_of)))
        .groupBy("month").agg(F.sum("m").alias("m"), F.sum("a").alias("a"))
    )
    series = running(running(fill_months(monthly, "m", "a"), "m", "monthly"), "a", "annual")
    return series.select(
        "month", dec_round(F.col("monthly").cast("double") + F.col("annual").cast("double") / 12, 4).alias("mrr")
    ).orderBy("month")


def revenue_lost_trend(t: Tables) -> DataFrame:
    gone = t.subscriptions.where((F.col("subscription_status") == CANCELLED) & F.col("cancellation_date").isNotNull())
    return (
        gone.groupBy(month_label("cancellation_date").alias("month"))
        .agg(F.sum(annualised()).cast("double").alias("annualized_revenue_lost")).orderBy("month")
    )


def risk_by_plan_region(t: Tables) -> DataFrame:
    """Model revenue at risk by plan and region."""
    at_risk = churn_model.worklist(churn_model.fitted(t).scores).select("customer_id", "plan_name", "revenue_at_risk")
    return (
        at_risk.join(t.customers.select("customer_id", "region"), "customer_id").groupBy("plan_name", "region")
        .agg(dec_round(F.sum("revenue_at_risk")).alias("revenue_at_risk"), F.count("*").alias("customers"))
    )


def segment_feed(t: Tables) -> DataFrame:
    return segment_summary(t).select("segment", "customers", "churn_rate", "total_revenue")


def tenure_histogram(t: Tables, bins: int = 24) -> DataFrame:
    return histogram(t.customers.select(tenure_months(t).alias("tenure_months")), "tenure_months", bins)


def _rates_by_dimension(t: Tables) -> DataFrame:
    """(dimension, value, customers, churned) of every dimension from one pass over the customers."""
    age_group = bands_left(F.col("age"), AGE_CUTS, AGE_LABELS)
    plans = t.plans.select("plan_id", "plan_name")
    # customers are reduced to the combinations of their attributes before the plan name is joined
    combos = (
        customer_status(t, "region", "acquisition_channel", "age").where(F.col("subscription_status").isNotNull())
        .groupBy("plan_id", "billing_cycle", "region", "acquisition_channel", age_group.alias("age_group"))
        .agg(F.count("*").alias("n"), F.sum(is_cancelled()).alias("gone"))
        .join(plans, "plan_id")
    )
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in FINDING_DIMENSIONS])
    return (
        combos.select("n", "gone", F.inline(cells)).where(F.col("value").isNotNull()).groupBy("dimension", "value")
        .agg(F.sum("n").alias("customers"), F.sum("gone").alias("churned"))
        .withColumn("churn_rate_pct", pct("churned", "customers"))
    )


def churn_gaps(t: Tables) -> DataFrame:
    """Worst and best group of every dimension and the gap between them, widest first."""
    order = F.struct("churn_rate_pct", "value")
    return (
        _rates_by_dimension(t).groupBy("dimension")
        .agg(
            F.max_by("value", order).alias("worst"), F.max("churn_rate_pct").alias("worst_rate_pct"),
            F.min_by("value", order).alias("best"), F.min("churn_rate_pct").alias("best_rate_pct"),
        )
        .withColumn("gap_points", dec_round(F.col("worst_rate_pct") - F.col("best_rate_pct")))
        .orderBy(F.desc("gap_points"), "dimension")
    )


def top_finding(t: Tables) -> DataFrame:
    """The widest gap, with a sentence for the overview page."""
    text = F.format_string(
        "%s: %s customers churn at %.2f%% against %.2f%% for %s", "dimension", "worst", "worst_rate_pct", "best_rate_pct", "best"
    )
    return churn_gaps(t).limit(1).withColumn("finding", text)


def worklist_filtered(t: Tables, priority: str = PRIORITY_LABELS[0]) -> DataFrame:
    """The outreach list of one priority only."""
    listed = churn_model.worklist(churn_model.fitted(t).scores).where(F.col("retention_priority") == priority)
    return (
        listed
        .select("customer_id", "plan_name", "annualized_revenue", "churn_probability", "risk_level", "retention_priority")
        .orderBy(F.desc("churn_probability"), "customer_id")
    )


def derived_grain(t: Tables) -> DataFrame:
    """Key uniqueness of the derived tables, and the number of listed customers that are not active."""
    from holdfast.plans.quality import duplicate_keys
    from holdfast.plans.rfm import rfm

    listed = churn_model.worklist(churn_model.fitted(t).scores).select("customer_id")
    active = latest_subscription(t.subscriptions, "subscription_status").where(F.col("subscription_status") != CANCELLED)
    stray = listed.join(active.select("customer_id"), "customer_id", "left_anti")
    return duplicate_keys({
        "churn_scores": (churn_model.scores(t), "customer_id"),
        "segments": (rfm(t), "customer_id"),
        "worklist": (listed, "customer_id"),
    }).unionByName(stray.agg(F.count("*").alias("repeated_keys")).select(
        F.lit("worklist_not_active").alias("relation"), "repeated_keys"
    ))
