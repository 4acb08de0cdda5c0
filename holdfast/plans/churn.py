"""Churn rates by dimension and over time (q18-q28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.functions.bands import bands_left
from holdfast.functions.business import CANCELLED, is_cancelled
from holdfast.functions.scalars import month_label, pct
from holdfast.operators.customer_grain import engagement_by_customer, latest_subscription, support_by_customer
from holdfast.operators.ranking import ntile_exact
from holdfast.operators.rates import churn_rate_by, churn_rate_from_counts
from holdfast.sources.tables import Tables

# Band edges and labels of the churn reports.
TENURE_DAY_CUTS = (90, 180, 365)
TENURE_DAY_LABELS = ("1 - 0-3 months", "2 - 3-6 months", "3 - 6-12 months", "4 - 12+ months")
AGE_CUTS = (25, 35, 45, 60)
AGE_LABELS = ("1 - Under 25", "2 - 25-34", "3 - 35-44", "4 - 45-59", "5 - 60+")
ENGAGEMENT_LABELS = ("1 - Low engagement", "2 - Medium engagement", "3 - High engagement")
SATISFACTION_CUTS = (2, 3, 4)
SATISFACTION_LABELS = ("1 - Very Low (<2)", "2 - Low (2-3)", "3 - Medium (3-4)", "4 - High (4-5)")
TICKET_CUTS = (1, 3, 5)
TICKET_LABELS = ("1 - No tickets", "2 - 1-2 tickets", "3 - 3-4 tickets", "4 - 5+ tickets")


def overall_churn_rate(t: Tables) -> DataFrame:
    return t.subscriptions.agg(
        pct(F.sum(is_cancelled()), F.count("*")).alias("overall_churn_rate_pct")
    )


def monthly_starts_and_cancellations(t: Tables) -> DataFrame:
    """(month label, starts, cancellations), one row per month that has either, in one scan of subscriptions."""
    dates = F.array(
        F.struct(month_label("start_date").alias("month"), F.lit(1).alias("s"), F.lit(0).alias("c")),
        F.struct(
            F.when(F.col("subscription_status") == CANCELLED, month_label("cancellation_date")).alias("month"),
            F.lit(0).alias("s"), is_cancelled().alias("c"),
        ),
    )
    return (
        t.subscriptions.select(F.inline(dates)).where(F.col("month").isNotNull())
        .groupBy("month").agg(F.sum("s").alias("starts"), F.sum("c").alias("cancellations"))
    )


def monthly_churn_rate(t: Tables) -> DataFrame:
    """Cancellations of a month over all subscriptions started up to and including it."""
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return (
        monthly_starts_and_cancellations(t).withColumn("base", F.sum("starts").over(so_far))
        .where(F.col("cancellations") > 0)
        .select("month", "cancellations", pct("cancellations", "base", 3).alias("approx_monthly_churn_rate_pct"))
        .orderBy("month")
    )


def _by_rate(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc("churn_rate_pct"), key)


def _sub_counts(t: Tables, key: str) -> DataFrame:
    """Subscriptions and cancellations per parent key, so a dominant parent joins as one row."""
    return t.subscriptions.groupBy(key).agg(F.count("*").alias("n"), F.sum(is_cancelled()).alias("cancelled"))


def churn_by_plan(t: Tables) -> DataFrame:
    named = _sub_counts(t, "plan_id").join(t.plans.select("plan_id", "plan_name"), "plan_id")
    return _by_rate(churn_rate_from_counts(named, "plan_name"), "plan_name")


def churn_by_billing(t: Tables) -> DataFrame:
    return _by_rate(churn_rate_by(t.subscriptions, "billing_cycle", "total_subs"), "billing_cycle")


def _churn_by_attribute(t: Tables, name: str, attribute: Column) -> DataFrame:
    parents = t.customers.select("customer_id", attribute.alias(name))
    return churn_rate_from_counts(_sub_counts(t, "customer_id").join(parents, "customer_id"), name)


def churn_by_region(t: Tables) -> DataFrame:
    return _by_rate(_churn_by_attribute(t, "region", F.col("region")), "region")


def churn_by_channel(t: Tables) -> DataFrame:
    name = "acquisition_channel"
    return _by_rate(_churn_by_attribute(t, name, F.col(name)), name)


def churn_by_tenure(t: Tables) -> DataFrame:
    lived = F.datediff(F.coalesce("end_date", F.lit(t.as_of)), F.col("start_date"))
    banded = t.subscriptions.select(
        bands_left(lived, TENURE_DAY_CUTS, TENURE_DAY_LABELS).alias("tenure_bucket"), "subscription_status"
    )
    return churn_rate_by(banded, "tenure_bucket", "total_subs").orderBy("tenure_bucket")


def churn_by_age(t: Tables) -> DataFrame:
    """A missing age falls into the last band."""
    return _churn_by_attribute(t, "age_group", bands_left(F.col("age"), AGE_CUTS, AGE_LABELS)).orderBy("age_group")


def churn_by_engagement(t: Tables) -> DataFrame:
    """Terciles of mean sessions over every customer with activity, then the latest status of those that subscribe."""
    usage = engagement_by_customer(t.activity).select("customer_id", "avg_sessions")
    tile = ntile_exact(usage, "avg_sessions", "customer_id", 3, "tercile")
    level = bands_left(F.col("tercile"), (2, 3), ENGAGEMENT_LABELS).alias("engagement_level")
    joined = tile.join(latest_subscription(t.subscriptions, "subscription_status"), "customer_id")
    return churn_rate_by(joined.select(level, "subscription_status"), "engagement_level").orderBy("engagement_level")


def churn_by_satisfaction(t: Tables) -> DataFrame:
    support = support_by_customer(t.tickets).select("customer_id", "avg_satisfaction")
    joined = support.join(latest_subscription(t.subscriptions, "subscription_status"), "customer_id")
    band = bands_left(F.col("avg_satisfaction"), SATISFACTION_CUTS, SATISFACTION_LABELS)
    banded = joined.select(band.alias("satisfaction_band"), "subscription_status")
    return churn_rate_by(banded, "satisfaction_band").orderBy("satisfaction_band")


def churn_by_tickets(t: Tables) -> DataFrame:
    """Customers without a ticket are counted as zero tickets."""
    support = support_by_customer(t.tickets).select("customer_id", "n_tickets")
    joined = latest_subscription(t.subscriptions, "subscription_status").join(support, "customer_id", "left")
    band = bands_left(F.coalesce("n_tickets", F.lit(0)), TICKET_CUTS, TICKET_LABELS)
    banded = joined.select(band.alias("ticket_volume_band"), "subscription_status")
    return churn_rate_by(banded, "ticket_volume_band").orderBy("ticket_volume_band")
