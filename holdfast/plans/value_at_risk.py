"""High-value customers, revenue at risk and the outreach shortlist (q40-q47)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from holdfast.functions.business import ACTIVE, annualised
from holdfast.functions.scalars import dec_round, pct
from holdfast.operators.customer_grain import (
    engagement_by_customer, latest_subscription, revenue_by_customer, support_by_customer,
)
from holdfast.operators.ranking import ntile_exact
from holdfast.plans.behaviour import revenue_quartiles
from holdfast.sources.tables import Tables

# Fixed values of the at-risk rule and of the shortlist score.
AT_RISK_SATISFACTION = 3
NO_SURVEY_SATISFACTION = 5
UNRESOLVED_POINTS = 1000
SATISFACTION_POINTS = 500
REVENUE_PER_POINT = 100
SHORTLIST_SIZE = 25


def _satisfaction():
    return F.coalesce("avg_satisfaction", F.lit(NO_SURVEY_SATISFACTION).cast("double"))


def _unresolved():
    return F.coalesce("unresolved", F.lit(0).cast("long"))


def top_decile_revenue(t: Tables) -> DataFrame:
    paid = revenue_by_customer(t.transactions).select("customer_id", "total_revenue")
    deciles = ntile_exact(paid, "total_revenue", "customer_id", 10, "decile", descending=True)
    top = F.col("decile") == 1
    return deciles.agg(
        F.count_if(top).alias("top_decile_customers"),
        F.sum(F.when(top, F.col("total_revenue"))).alias("best"),
        F.sum("total_revenue").alias("everyone"),
    ).select(
        "top_decile_customers", F.col("best").cast("double").alias("revenue_from_top_decile"),
        pct("best", "everyone").alias("pct_of_total_revenue"),
    )


def high_value_at_risk(t: Tables) -> DataFrame:
    top = revenue_quartiles(t).where(F.col("quartile") == 4).select("customer_id", "total_revenue")
    active = latest_subscription(t.subscriptions, "subscription_status").where(F.col("subscription_status") == ACTIVE)
    joined = top.join(active, "customer_id").join(support_by_customer(t.tickets), "customer_id", "left")
    return joined.where((_satisfaction() <= AT_RISK_SATISFACTION) | (_unresolved() >= 1)).agg(
        F.count("*").alias("high_value_at_risk_customers"),
        F.sum("total_revenue").cast("double").alias("revenue_at_risk"),
    )


def high_ticket_customers(t: Tables) -> DataFrame:
    counts = support_by_customer(t.tickets).select("customer_id", "n_tickets")
    top = ntile_exact(counts, "n_tickets", "customer_id", 10, "decile", descending=True).where(F.col("decile") == 1)
    return top.agg(F.count("*").alias("high_ticket_customers"), F.min("n_tickets").alias("min_tickets_in_group"))


def high_revenue_low_engagement(t: Tables) -> DataFrame:
    top = revenue_quartiles(t).where(F.col("quartile") == 4)
    usage = engagement_by_customer(t.activity).select("customer_id", "avg_sessions")
    low = ntile_exact(usage, "avg_sessions", "customer_id", 3, "tercile").where(F.col("tercile") == 1)
    return top.join(low.select("customer_id"), "customer_id").agg(
        F.count("*").alias("high_revenue_low_engagement_customers"),
        F.sum("total_revenue").cast("double").alias("revenue_represented"),
    )


def _at_risk(t: Tables) -> DataFrame:
    """(customer_id, plan_id, value) of active customers with low satisfaction."""
    latest = latest_subscription(t.subscriptions, "plan_id", "subscription_status", "billing_cycle", "monthly_price")
    support = support_by_customer(t.tickets).select("customer_id", "avg_satisfaction")
    return (
        latest.where(F.col("subscription_status") == ACTIVE).join(support, "customer_id", "left")
        .where(_satisfaction() <= AT_RISK_SATISFACTION)
        .select("customer_id", "plan_id", annualised().alias("value"))
    )


def _risk_total(df: DataFrame, key: str) -> DataFrame:
    return (
        df.groupBy(key).agg(F.sum("value").cast("double").alias("at_risk_revenue"))
        .orderBy(F.desc("at_risk_revenue"), key)
    )


def risk_revenue_by_plan(t: Tables) -> DataFrame:
    per_plan = _at_risk(t).groupBy("plan_id").agg(F.sum("value").alias("value"))
    return _risk_total(per_plan.join(t.plans.select("plan_id", "plan_name"), "plan_id"), "plan_name")


def _risk_revenue_by_attribute(t: Tables, key: str) -> DataFrame:
    return _risk_total(_at_risk(t).join(t.customers.select("customer_id", key), "customer_id"), key)


def risk_revenue_by_region(t: Tables) -> DataFrame:
    return _risk_revenue_by_attribute(t, "region")


def risk_revenue_by_channel(t: Tables) -> DataFrame:
    return _risk_revenue_by_attribute(t, "acquisition_channel")


def retention_worklist(t: Tables, size: int = SHORTLIST_SIZE) -> DataFrame:
    """Top active customers by unresolved tickets, dissatisfaction and revenue; a distributed top-k."""
    active = latest_subscription(t.subscriptions, "subscription_status").where(F.col("subscription_status") == ACTIVE)
    joined = (
        active.join(revenue_by_customer(t.transactions), "customer_id")
        .join(support_by_customer(t.tickets), "customer_id", "left")
    )
    score = (
        _unresolved() * UNRESOLVED_POINTS
        + (NO_SURVEY_SATISFACTION - _satisfaction()) * SATISFACTION_POINTS
        + F.col("total_revenue").cast("double") / float(REVENUE_PER_POINT)
    )
    return (
        joined.orderBy(score.desc(), "customer_id").limit(size)
        .select(
            "customer_id", F.col("total_revenue").cast("double").alias("total_revenue"),
            dec_round(_satisfaction()).alias("avg_satisfaction"), _unresolved().alias("unresolved_tickets"),
        )
    )
