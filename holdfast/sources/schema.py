"""Column types, value checks and key relationships of the eight tables.

Spark does not enforce keys or CHECK constraints, so they are kept here as data
and evaluated by ``holdfast.plans.quality``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

_LONG, _INT, _STR, _DATE = T.LongType(), T.IntegerType(), T.StringType(), T.DateType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


SCHEMAS: dict[str, T.StructType] = {
    "customers": _struct(
        ("customer_id", _LONG), ("signup_date", _DATE), ("gender", _STR), ("age", _INT), ("country", _STR),
        ("region", _STR), ("acquisition_channel", _STR), ("referral_source", _STR),
    ),
    "plans": _struct(
        ("plan_id", _INT), ("plan_name", _STR), ("plan_type", _STR), ("monthly_price", T.DecimalType(8, 2)),
        ("max_devices", _INT), ("premium_support", _INT),
    ),
    "subscriptions": _struct(
        ("subscription_id", _LONG), ("customer_id", _LONG), ("plan_id", _INT), ("start_date", _DATE),
        ("end_date", _DATE), ("billing_cycle", _STR), ("monthly_price", T.DecimalType(8, 2)),
        ("discount_percentage", _INT), ("subscription_status", _STR), ("cancellation_date", _DATE),
        ("cancellation_reason", _STR),
    ),
    "transactions": _struct(
        ("transaction_id", _LONG), ("customer_id", _LONG), ("subscription_id", _LONG), ("transaction_date", _DATE),
        ("transaction_type", _STR), ("amount", T.DecimalType(18, 2)), ("discount_amount", T.DecimalType(18, 2)),
        ("payment_status", _STR),
    ),
    "customer_activity": _struct(
        ("activity_id", _LONG), ("customer_id", _LONG), ("activity_date", _DATE), ("sessions", _INT),
        ("session_minutes", _INT), ("content_consumed", _INT), ("feature_usage_count", _INT),
    ),
    "support_tickets": _struct(
        ("ticket_id", _LONG), ("customer_id", _LONG), ("ticket_date", _DATE), ("issue_type", _STR),
        ("resolution_time_hours", T.DecimalType(6, 1)), ("satisfaction_score", _INT), ("ticket_status", _STR),
    ),
    "marketing_campaigns": _struct(
        ("campaign_id", _LONG), ("campaign_date", _DATE), ("channel", _STR), ("campaign_type", _STR),
        ("spend", T.DecimalType(10, 2)),
    ),
    "customer_campaign_interactions": _struct(
        ("interaction_id", _LONG), ("customer_id", _LONG), ("campaign_id", _LONG), ("interaction_type", _STR),
        ("interaction_date", _DATE),
    ),
}


REQUIRED_COLUMNS: dict[str, list[str]] = {
    "customers": ["signup_date"],
    "plans": ["plan_name", "monthly_price"],
    "subscriptions": ["customer_id", "plan_id", "start_date", "monthly_price"],
    "transactions": ["customer_id", "subscription_id", "transaction_date", "amount"],
    "customer_activity": ["customer_id", "activity_date"],
    "support_tickets": ["customer_id", "ticket_date"],
    "marketing_campaigns": ["campaign_date"],
    "customer_campaign_interactions": ["customer_id", "campaign_id", "interaction_date"],
}


def domain_checks() -> dict[str, dict[str, Column]]:
    """Per table: check name -> condition that is true on a *violating* row (NULL passes, as in SQL CHECK)."""
    c = F.col
    return {
        "customers": {
            "age_in_range": ~c("age").between(13, 100),
        },
        "plans": {
            "monthly_price_non_negative": c("monthly_price") < 0,
            "premium_support_flag": ~c("premium_support").isin(0, 1),
        },
        "subscriptions": {
            "billing_cycle_domain": ~c("billing_cycle").isin("Monthly", "Annual"),
            "monthly_price_non_negative": c("monthly_price") < 0,
            "discount_in_range": ~c("discount_percentage").between(0, 100),
            "status_domain": ~c("subscription_status").isin("Active", "Cancelled"),
            "end_not_before_start": c("end_date") < c("start_date"),
        },
        "support_tickets": {
            "satisfaction_in_range": ~c("satisfaction_score").between(1, 5),
        },
    }


# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("subscriptions", "customer_id", "customers", "customer_id"),
    ("subscriptions", "plan_id", "plans", "plan_id"),
    ("transactions", "customer_id", "customers", "customer_id"),
    ("transactions", "subscription_id", "subscriptions", "subscription_id"),
    ("customer_activity", "customer_id", "customers", "customer_id"),
    ("support_tickets", "customer_id", "customers", "customer_id"),
    ("customer_campaign_interactions", "customer_id", "customers", "customer_id"),
    ("customer_campaign_interactions", "campaign_id", "marketing_campaigns", "campaign_id"),
]
