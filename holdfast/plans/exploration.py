"""The aggregates behind the exploratory charts (e01-e18).

Churn rates here are at customer grain (latest subscription), unlike q20-q25.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.bands import bands_right
from holdfast.functions.business import CANCELLED, is_cancelled, recognised
from holdfast.functions.scalars import pct
from holdfast.operators.customer_grain import engagement_by_customer, latest_subscription, support_by_customer
from holdfast.operators.histogram import histogram
from holdfast.operators.quantiles import exact_quantiles
from holdfast.operators.rates import churn_rate_by, count_by
from holdfast.operators.timeline import by_month, fill_months, running
from holdfast.plans.revenue import revenue_by_attribute
from holdfast.sources.tables import Tables

# Bin counts, band edges (closed on the right, None: open) and labels of the charts.
AGE_BINS = 30
TENURE_BINS = 40
DENSITY_BINS = 50
DENSITY_AXIS_QUANTILE = 0.98
TICKET_EDGES, TICKET_BANDS = (None, 0, 2, 4, None), ("0", "1-2", "3-4", "5+")
SAT_EDGES, SAT_BANDS = (0, 2, 3, 4, 5), ("1-2", "2-3", "3-4", "4-5")
DISCOUNT_EDGES, DISCOUNT_BANDS = (-1, 0, 10, 20, 100), ("0%", "1-10%", "11-20%", "21%+")
AGE_EDGES, AGE_BANDS = (0, 25, 35, 45, 60, 100), ("<25", "25-34", "35-44", "45-59", "60+")
WHISKER = 1.5


def customer_status(t: Tables, *attributes: str) -> DataFrame:
    """Every customer with the named attributes and its latest plan, billing cycle and status, if any."""
    latest = latest_subscription(t.subscriptions, "plan_id", "billing_cycle", "subscription_status")
    return t.customers.select("customer_id", *attributes).join(latest, "customer_id", "left")


def _rate(df: DataFrame, key: str | Column, name: str | None = None) -> DataFrame:
    name = name or key
    banded = df.select((F.col(key) if isinstance(key, str) else key).alias(name), "subscription_status")
    return churn_rate_by(banded.where(F.col(name).isNotNull()), name)


def age_histogram(t: Tables) -> DataFrame:
    return histogram(t.customers, "age", AGE_BINS)


def customer_growth(t: Tables) -> DataFrame:
    monthly = by_month(t.customers, "signup_date", new_customers=F.count("*"))
    return running(fill_months(monthly, "new_customers"), "new_customers", "cumulative").orderBy("month")


def monthly_revenue_filled(t: Tables) -> DataFrame:
    monthly = by_month(t.transactions.where(recognised()), "transaction_date", revenue=F.sum("amount"))
    return fill_months(monthly, "revenue").select("month", F.col("revenue").cast("double").alias("revenue")).orderBy("month")


def plan_counts(t: Tables) -> DataFrame:
    per_plan = count_by(latest_subscription(t.subscriptions, "plan_id"), "plan_id", "n")
    named = per_plan.join(t.plans.select("plan_id", "plan_name"), "plan_id")
    return named.groupBy("plan_name").agg(F.sum("n").alias("customers"))


def channel_counts(t: Tables) -> DataFrame:
    return count_by(t.customers, "acquisition_channel")


def churn_by_channel(t: Tables) -> DataFrame:
    return _rate(customer_status(t, "acquisition_channel"), "acquisition_channel").orderBy(F.desc("churn_rate_pct"))


def churn_by_plan(t: Tables) -> DataFrame:
    per_plan = customer_status(t).groupBy("plan_id").agg(F.count("*").alias("n"), F.sum(is_cancelled()).alias("gone"))
    named = per_plan.join(t.plans.select("plan_id", "plan_name"), "plan_id")
    return (
        named.groupBy("plan_name").agg(F.sum("n").alias("customers"), F.sum("gone").alias("churned"))
        .withColumn("churn_rate_pct", pct("churned", "customers")).orderBy(F.desc("churn_rate_pct"))
    )


def churn_by_billing(t: Tables) -> DataFrame:
    return _rate(customer_status(t), "billing_cycle")


def monthly_cancellations(t: Tables) -> DataFrame:
    gone = t.subscriptions.where(F.col("subscription_status") == CANCELLED)
    return fill_months(by_month(gone, "cancellation_date", cancellations=F.count("*")), "cancellations").orderBy("month")


def sessions_density(t: Tables, bins: int = DENSITY_BINS) -> DataFrame:
    """Density of mean sessions per status, each normalised to area 1; ``x_limit`` is the chart's axis end."""
    usage = engagement_by_customer(t.activity).select("customer_id", "avg_sessions")
    merged = customer_status(t).select("customer_id", "subscription_status").join(usage, "customer_id")
    known = merged.where(F.col("subscription_status").isNotNull())
    cells = histogram(known, "avg_sessions", bins, by="subscription_status")
    sizes = known.groupBy("subscription_status").agg(F.count("*").alias("size"))
    limit = exact_quantiles(merged, "avg_sessions", [DENSITY_AXIS_QUANTILE]).select("q0").scalar()
    return cells.join(sizes, "subscription_status").select(
        "subscription_status", "bin", "bin_start", "bin_end", "n",
        (F.col("n") / (F.col("size") * (F.col("bin_end") - F.col("bin_start")))).alias("density"),
        limit.alias("x_limit"),
    )


def churn_by_ticket_band(t: Tables) -> DataFrame:
    support = support_by_customer(t.tickets).select("customer_id", "n_tickets")
    merged = customer_status(t).join(support, "customer_id", "left")
    return _rate(merged, bands_right(F.coalesce("n_tickets", F.lit(0)), TICKET_EDGES, TICKET_BANDS), "ticket_band")


def churn_by_sat_band(t: Tables) -> DataFrame:
    support = support_by_customer(t.tickets).select("customer_id", "avg_satisfaction")
    merged = customer_status(t).join(support, "customer_id")
    return _rate(merged, bands_right(F.col("avg_satisfaction"), SAT_EDGES, SAT_BANDS), "sat_band")


def tenure_at_churn(t: Tables) -> DataFrame:
    """Histogram of days from start to cancellation, with the median on every row."""
    days = F.datediff("cancellation_date", "start_date").alias("tenure_days")
    gone = t.subscriptions.where(F.col("subscription_status") == CANCELLED).select(days)
    # whole days of a service life: a bounded domain for the built-in median
    median = gone.agg(F.median("tenure_days")).scalar()
    return histogram(gone, "tenure_days", TENURE_BINS).withColumn("median_days", median)


def revenue_by_region(t: Tables) -> DataFrame:
    return revenue_by_attribute(t, "region")


def churn_by_discount_band(t: Tables) -> DataFrame:
    latest = latest_subscription(t.subscriptions, "discount_percentage", "subscription_status")
    return _rate(latest, bands_right(F.col("discount_percentage"), DISCOUNT_EDGES, DISCOUNT_BANDS), "disc_band")


def feature_usage_box(t: Tables) -> DataFrame:
    """Quartiles per status and the extreme values inside the 1.5 IQR fences."""
    usage = engagement_by_customer(t.activity).select("customer_id", "avg_feature_usage")
    merged = customer_status(t).join(usage, "customer_id").where(F.col("subscription_status").isNotNull())
    box = exact_quantiles(merged, "avg_feature_usage", [0.25, 0.5, 0.75], by="subscription_status").select(
        "subscription_status", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    # rows are (status, value); the other side has three numbers per status
    x, spread = F.col("avg_feature_usage"), (F.col("q3") - F.col("q1")) * WHISKER
    inside = (x >= F.col("q1") - spread) & (x <= F.col("q3") + spread)
    return (
        merged.select("subscription_status", "avg_feature_usage").join(box, "subscription_status", "left")
        .groupBy("subscription_status", "q1", "median", "q3")
        .agg(F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"))
    )


def churn_by_age_band(t: Tables) -> DataFrame:
    return _rate(customer_status(t, "age"), bands_right(F.col("age"), AGE_EDGES, AGE_BANDS), "age_group")


def headline(t: Tables) -> DataFrame:
    """Row counts, churn over customers that subscribed, and total revenue, in one row."""
    subs = t.subscriptions.agg(F.count("*")).scalar()
    txns = t.transactions.agg(F.struct(F.count("*").alias("n"), F.sum(F.when(recognised(), F.col("amount"))).alias("r"))).scalar()
    churn = latest_subscription(t.subscriptions, "subscription_status").agg(pct(F.sum(is_cancelled()), F.count("*"))).scalar()
    return t.customers.agg(F.count("*").alias("customers")).select(
        "customers", subs.alias("subscriptions"), txns.getField("n").alias("transactions"),
        churn.alias("churn_rate_pct"), txns.getField("r").cast("double").alias("total_revenue"),
    )
