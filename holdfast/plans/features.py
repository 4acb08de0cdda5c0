"""Point-in-time churn features, one row per customer with a subscription (f01-f08).

Facts count only up to the customer's own observation date: its cancellation if
it churned, else the cutoff. Each fact is first reduced to customer and day, so
a customer that dominates a fact joins with at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.business import CANCELLED, UNRESOLVED, is_cancelled, recognised
from holdfast.functions.scalars import dec_round, ratio
from holdfast.operators.customer_grain import subscription_order
from holdfast.operators.quantiles import exact_median
from holdfast.operators.stable import stable
from holdfast.sources.tables import Tables

# Trend window, its clip and the mean month length.
TREND_DAYS = 45
TREND_MAX = 5.0
NEUTRAL_TREND = 1.0
DAYS_PER_MONTH = 30.44
FEATURE_COLUMNS = [
    "customer_id", "age", "acquisition_channel", "plan_name", "billing_cycle", "monthly_price", "discount_percentage",
    "premium_support", "tenure_days", "tenure_months", "avg_sessions", "avg_session_minutes", "avg_feature_usage",
    "engagement_trend_ratio", "total_tickets", "avg_satisfaction", "avg_resolution_time", "unresolved_tickets",
    "total_revenue", "total_transactions", "recency_days", "churn",
]


def subscription_ends(t: Tables) -> DataFrame:
    """Per customer: attributes of the first subscription, label and observation date by the latest, in one aggregation."""
    order = subscription_order()
    first = F.struct("plan_id", "billing_cycle", "monthly_price", "discount_percentage", "start_date")
    latest = F.struct("subscription_status", "cancellation_date")
    as_of = F.when(F.col("subscription_status") == CANCELLED, F.col("cancellation_date")).otherwise(F.lit(t.as_of))
    return (
        t.subscriptions.groupBy("customer_id")
        .agg(F.min_by(first, order).alias("first"), F.max_by(latest, order).alias("latest"))
        .select("customer_id", "first.*", "latest.*").withColumn("as_of_date", as_of)
    )


def observation_window(t: Tables) -> DataFrame:
    """Customers that subscribed, with the attributes and dates their features are computed from."""
    plans = t.plans.select("plan_id", "plan_name", "plan_type", "premium_support")
    return (
        t.customers.select("customer_id", "age", "acquisition_channel")
        .join(subscription_ends(t), "customer_id").join(plans, "plan_id", "left")
        .select(
            "customer_id", "age", "acquisition_channel", "plan_id", "plan_name", "plan_type", "premium_support",
            "billing_cycle", F.col("monthly_price").cast("double").alias("monthly_price"), "discount_percentage",
            "start_date", "as_of_date", is_cancelled().alias("churn"),
        )
    )


def with_tenure(window: DataFrame) -> DataFrame:
    days = F.greatest(F.datediff("as_of_date", "start_date"), F.lit(1))
    return window.withColumn("tenure_days", days).withColumn(
        "tenure_months", dec_round(F.col("tenure_days") / DAYS_PER_MONTH, 1)
    )


def _observed(daily: DataFrame, ends: DataFrame, day: str) -> DataFrame:
    """Daily facts up to the customer's observation date, with their age in days."""
    return (
        daily.join(ends.select("customer_id", "as_of_date"), "customer_id").where(F.col(day) <= F.col("as_of_date"))
        .withColumn("days_before", F.datediff("as_of_date", day))
    )


def _mean(total: str, count: str, when: Column | None = None) -> Column:
    pick = (lambda c: F.sum(F.when(when, F.col(c)))) if when is not None else F.sum
    return ratio(pick(total), pick(count))


def engagement(t: Tables, ends: DataFrame, trend_days: int = TREND_DAYS) -> DataFrame:
    """Means, record count, last date and recent-to-prior ratio of sessions from one pass."""
    measures = {"sessions": "sessions", "minutes": "session_minutes", "features": "feature_usage_count"}
    daily = t.activity.groupBy("customer_id", "activity_date").agg(
        F.count("activity_id").alias("records"),
        *[F.sum(c).alias(f"{m}_sum") for m, c in measures.items()],
        *[F.count(c).alias(f"{m}_n") for m, c in measures.items()],
    )
    age = F.col("days_before")
    recent, prior = age <= trend_days, (age > trend_days) & (age <= 2 * trend_days)
    trend = ratio(_mean("sessions_sum", "sessions_n", recent), _mean("sessions_sum", "sessions_n", prior))
    return _observed(daily, ends, "activity_date").groupBy("customer_id").agg(
        _mean("sessions_sum", "sessions_n").alias("avg_sessions"),
        _mean("minutes_sum", "minutes_n").alias("avg_session_minutes"),
        _mean("features_sum", "features_n").alias("avg_feature_usage"),
        F.sum("records").alias("total_activity_periods"),
        F.max("activity_date").alias("last_activity_date"),
        trend.alias("trend"),
    )


def support(t: Tables, ends: DataFrame) -> DataFrame:
    daily = t.tickets.groupBy("customer_id", "ticket_date").agg(
        F.count("ticket_id").alias("tickets"),
        F.sum("satisfaction_score").alias("sat_sum"), F.count("satisfaction_score").alias("sat_n"),
        F.sum("resolution_time_hours").alias("res_sum"), F.count("resolution_time_hours").alias("res_n"),
        F.count_if(F.col("ticket_status") == UNRESOLVED).alias("unresolved"),
    )
    return _observed(daily, ends, "ticket_date").groupBy("customer_id").agg(
        F.sum("tickets").alias("total_tickets"),
        _mean("sat_sum", "sat_n").alias("avg_satisfaction"),
        _mean("res_sum", "res_n").alias("avg_resolution_time"),
        F.sum("unresolved").alias("unresolved_tickets"),
    )


def revenue(t: Tables, ends: DataFrame) -> DataFrame:
    daily = t.transactions.where(recognised()).groupBy("customer_id", "transaction_date").agg(
        F.sum("amount").alias("paid"), F.count("amount").alias("charges")
    )
    return _observed(daily, ends, "transaction_date").groupBy("customer_id").agg(
        F.sum("paid").cast("double").alias("total_revenue"),
        F.sum("charges").alias("total_transactions"),
        F.min("days_before").alias("recency_days"),
    )


def _clipped_trend() -> Column:
    return F.greatest(F.least(F.coalesce("trend", F.lit(NEUTRAL_TREND)), F.lit(TREND_MAX)), F.lit(0.0))


def features(t: Tables) -> DataFrame:
    """The 22-column feature table with its defaults for customers without facts."""
    # every fact is cut at the same dates; the exchange that computes them is reused
    window, ends = with_tenure(observation_window(t)), subscription_ends(t)
    # the satisfaction default is the median over customers, so the support part is written once and read twice
    cases = stable(support(t, ends))
    zero = F.lit(0)
    joined = (
        window.join(engagement(t, ends), "customer_id", "left").join(cases, "customer_id", "left")
        .join(revenue(t, ends), "customer_id", "left")
    )
    return joined.withColumns({
        **{c: F.coalesce(c, F.lit(0.0)) for c in (
            "avg_sessions", "avg_session_minutes", "avg_feature_usage", "avg_resolution_time", "total_revenue")},
        **{c: F.coalesce(c, zero).cast("long") for c in ("total_tickets", "unresolved_tickets", "total_transactions")},
        "avg_satisfaction": F.coalesce("avg_satisfaction", exact_median(cases, "avg_satisfaction")),
        "engagement_trend_ratio": _clipped_trend(),
        "recency_days": F.coalesce("recency_days", "tenure_days"),
    }).select(*FEATURE_COLUMNS)


# ---- reports --------------------------------------------------------------------------------------------------------


def tenure_report(t: Tables) -> DataFrame:
    return with_tenure(observation_window(t)).select("customer_id", "tenure_days", "tenure_months")


def engagement_report(t: Tables) -> DataFrame:
    return engagement(t, observation_window(t)).drop("trend")


def trend_report(t: Tables) -> DataFrame:
    joined = observation_window(t).select("customer_id").join(engagement(t, subscription_ends(t)), "customer_id", "left")
    return joined.select("customer_id", _clipped_trend().alias("engagement_trend_ratio"))


def support_report(t: Tables) -> DataFrame:
    return features(t).select(
        "customer_id", "total_tickets", "avg_satisfaction", "avg_resolution_time", "unresolved_tickets"
    )


def revenue_report(t: Tables) -> DataFrame:
    window = with_tenure(observation_window(t)).select("customer_id", "tenure_days")
    return window.join(revenue(t, subscription_ends(t)), "customer_id", "left").select(
        "customer_id", F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
        F.coalesce("total_transactions", F.lit(0)).cast("long").alias("total_transactions"),
        F.coalesce("recency_days", "tenure_days").alias("recency_days"),
    )


def feature_profile(t: Tables) -> DataFrame:
    """(metric, value): rows, columns, churn rate, and missing values per column that has any."""
    table = features(t)
    one = table.agg(
        F.count("*").cast("double").alias("rows"), dec_round(F.avg("churn"), 4).alias("churn_rate"),
        *[F.count_if(F.col(c).isNull()).cast("double").alias(f"missing_{c}") for c in FEATURE_COLUMNS],
    ).withColumn("columns", F.lit(float(len(FEATURE_COLUMNS))))
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns]
    return one.select(F.inline(F.array(*cells))).where(~F.col("metric").startswith("missing_") | (F.col("value") > 0))
