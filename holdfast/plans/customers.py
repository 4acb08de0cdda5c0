"""Customer counts: totals, status, growth and mix (q01-q08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from holdfast.functions.bands import bands_left
from holdfast.functions.business import ACTIVE, CANCELLED
from holdfast.functions.scalars import month_label
from holdfast.operators.customer_grain import latest_subscription
from holdfast.operators.rates import count_by, share_of_total
from holdfast.sources.tables import Tables

# Tenure bands in months since signup.
TENURE_MONTH_CUTS = (3, 6, 12, 18)
TENURE_MONTH_LABELS = ("1 - 0-2 months", "2 - 3-5 months", "3 - 6-11 months", "4 - 12-17 months", "5 - 18+ months")
DAYS_PER_MONTH = 30


def tenure_months(t: Tables, signup: str = "signup_date"):
    """Whole 30-day months from signup to the observation date."""
    return (F.datediff(F.lit(t.as_of), F.col(signup)) / DAYS_PER_MONTH).cast("int")


def total_customers(t: Tables) -> DataFrame:
    return t.customers.agg(F.count("*").alias("total_customers"))


def _with_status(t: Tables, status: str, name: str) -> DataFrame:
    latest = latest_subscription(t.subscriptions, "subscription_status")
    return latest.where(F.col("subscription_status") == status).agg(F.count("*").alias(name))


def active_customers(t: Tables) -> DataFrame:
    return _with_status(t, ACTIVE, "active_customers")


def churned_customers(t: Tables) -> DataFrame:
    return _with_status(t, CANCELLED, "churned_customers")


def new_customers_by_month(t: Tables) -> DataFrame:
    months = t.customers.groupBy(month_label("signup_date").alias("signup_month"))
    return months.agg(F.count("*").alias("new_customers")).orderBy("signup_month")


def customer_mix(t: Tables, key: str) -> DataFrame:
    """Customers and share per value of a customer attribute; each customer counts once."""
    return share_of_total(count_by(t.customers, key), "customers").orderBy(F.desc("customers"), key)


def customers_by_region(t: Tables) -> DataFrame:
    return customer_mix(t, "region")


def customers_by_channel(t: Tables) -> DataFrame:
    return customer_mix(t, "acquisition_channel")


def customers_by_plan(t: Tables) -> DataFrame:
    per_plan = count_by(latest_subscription(t.subscriptions, "plan_id"), "plan_id", "n")
    return (
        per_plan.join(t.plans.select("plan_id", "plan_name"), "plan_id")
        .groupBy("plan_name").agg(F.sum("n").alias("customers"))
        .orderBy(F.desc("customers"), "plan_name")
    )


def customers_by_tenure(t: Tables) -> DataFrame:
    bucket = bands_left(tenure_months(t), TENURE_MONTH_CUTS, TENURE_MONTH_LABELS)
    return count_by(t.customers.select(bucket.alias("tenure_bucket")), "tenure_bucket").orderBy("tenure_bucket")
