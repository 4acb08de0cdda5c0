"""Revenue totals, trend, mix and recurring value lost or at risk (q09-q17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from holdfast.functions.business import ACTIVE, CANCELLED, annualised, recognised
from holdfast.functions.scalars import dec_round, month_label, pct, ratio
from holdfast.operators.customer_grain import latest_subscription, revenue_by_customer, support_by_customer
from holdfast.operators.rates import share_of_total
from holdfast.sources.tables import Tables

# Fixed values of the simple at-risk rule.
LOW_SATISFACTION = 2.5
MANY_UNRESOLVED = 2
NO_SURVEY_SATISFACTION = 5


def _money(name: str):
    return F.col(name).cast("double").alias(name)


def total_revenue(t: Tables) -> DataFrame:
    return t.transactions.where(recognised()).agg(F.sum("amount").cast("double").alias("total_revenue"))


def _monthly(t: Tables) -> DataFrame:
    return (
        t.transactions.where(recognised()).groupBy(month_label("transaction_date").alias("revenue_month"))
        .agg(F.sum("amount").alias("revenue"))
    )


def monthly_revenue(t: Tables) -> DataFrame:
    return _monthly(t).select("revenue_month", _money("revenue")).orderBy("revenue_month")


def mom_growth(t: Tables) -> DataFrame:
    """Growth over the previous month that has revenue. The window runs over one row per month."""
    before = F.lag("revenue").over(Window.orderBy("revenue_month"))
    return _monthly(t).select(
        "revenue_month", _money("revenue"), pct(F.col("revenue") - before, before).alias("mom_growth_pct")
    ).orderBy("revenue_month")


def revenue_by_plan(t: Tables) -> DataFrame:
    """Through the plan of the subscription that was charged, reduced per subscription and per plan before each join."""
    per_sub = t.transactions.where(recognised()).groupBy("subscription_id").agg(F.sum("amount").alias("paid"))
    per_plan = (
        per_sub.join(t.subscriptions.select("subscription_id", "plan_id"), "subscription_id", "left")
        .groupBy("plan_id").agg(F.sum("paid").alias("paid"))
    )
    named = (
        per_plan.join(t.plans.select("plan_id", "plan_name"), "plan_id", "left")
        .groupBy("plan_name").agg(F.sum("paid").alias("revenue"))
    )
    # the denominator is all recognised revenue, also of charges without a known subscription; one row per plan here
    shared = share_of_total(named, "revenue").where(F.col("plan_name").isNotNull())
    return shared.select("plan_name", _money("revenue"), "pct_of_total").orderBy(F.desc("revenue"))


def revenue_by_attribute(t: Tables, key: str) -> DataFrame:
    paid = revenue_by_customer(t.transactions).select("customer_id", "total_revenue")
    return (
        paid.join(t.customers.select("customer_id", key), "customer_id")
        .groupBy(key).agg(F.sum("total_revenue").cast("double").alias("revenue"))
        .orderBy(F.desc("revenue"), key)
    )


def revenue_by_region(t: Tables) -> DataFrame:
    return revenue_by_attribute(t, "region")


def revenue_by_channel(t: Tables) -> DataFrame:
    return revenue_by_attribute(t, "acquisition_channel")


def arpu(t: Tables) -> DataFrame:
    """All-time revenue over all customers, paying or not."""
    paid = t.transactions.where(recognised()).agg(F.sum("amount")).scalar()
    return t.customers.agg(F.countDistinct("customer_id").alias("n")).select(
        dec_round(ratio(paid, "n")).alias("arpu_all_time")
    )


def revenue_lost(t: Tables) -> DataFrame:
    """Yearly value of every cancelled subscription, not only the latest ones."""
    cancelled = t.subscriptions.where(F.col("subscription_status") == CANCELLED)
    return cancelled.agg(F.sum(annualised()).cast("double").alias("annualized_revenue_lost_to_churn"))


def naive_revenue_at_risk(t: Tables) -> DataFrame:
    """Yearly value of active customers with poor satisfaction or several unresolved tickets."""
    latest = latest_subscription(t.subscriptions, "subscription_status", "billing_cycle", "monthly_price")
    unhappy = (
        (F.coalesce("avg_satisfaction", F.lit(NO_SURVEY_SATISFACTION)) <= LOW_SATISFACTION)
        | (F.coalesce("unresolved", F.lit(0)) >= MANY_UNRESOLVED)
    )
    return (
        latest.where(F.col("subscription_status") == ACTIVE)
        .join(support_by_customer(t.tickets), "customer_id", "left").where(unhappy)
        .agg(F.sum(annualised()).cast("double").alias("naive_revenue_at_risk"))
    )
