"""Small hand-made tables with the declared schemas."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from holdfast.sources.schema import SCHEMAS
from holdfast.sources.tables import Tables

AS_OF = dt.date(2001, 9, 1)

DEFAULTS = {
    "customers": dict(signup_date="2000-01-01", gender="Male", age=30, country="France", region="EUROPE",
                      acquisition_channel="Direct", referral_source="Other"),
    "plans": dict(plan_type="Individual", max_devices=1, premium_support=0),
    "subscriptions": dict(plan_id=1, start_date="2000-01-01", billing_cycle="Monthly", monthly_price="10.00",
                          discount_percentage=0, subscription_status="Active"),
    "transactions": dict(transaction_date="2000-02-01", transaction_type="Subscription Charge", amount="10.00",
                         discount_amount="0.00", payment_status="Success"),
    "customer_activity": dict(activity_date="2001-08-15", sessions=5, session_minutes=50, content_consumed=1,
                              feature_usage_count=2),
    "support_tickets": dict(ticket_date="2001-08-15", issue_type="Billing", resolution_time_hours="4.0",
                            satisfaction_score=3, ticket_status="Resolved"),
    "marketing_campaigns": dict(campaign_date="2000-01-01", channel="Email", campaign_type="Promotion", spend="5.00"),
    "customer_campaign_interactions": dict(campaign_id=1, interaction_type="Click", interaction_date="2000-01-02"),
}


def frame(spark, table: str, rows: list[dict], extra: str | None = None):
    """Rows with defaults filled in; ``extra`` names an additional leading integer column."""
    from pyspark.sql import types as T

    schema = SCHEMAS[table]
    if extra:
        schema = T.StructType([T.StructField(extra, T.IntegerType()), *schema.fields])

    def cast(field, value):
        if value is None:
            return None
        if isinstance(field.dataType, T.DateType):
            return dt.date.fromisoformat(value) if isinstance(value, str) else value
        if isinstance(field.dataType, T.DecimalType):
            return Decimal(value)
        return value

    filled = [{**DEFAULTS[table], **row} for row in rows]
    return spark.createDataFrame([tuple(cast(f, r.get(f.name)) for f in schema.fields) for r in filled], schema)


def tables(spark, as_of: dt.date = AS_OF, **rows: list[dict]) -> Tables:
    rows.setdefault("plans", [dict(plan_id=1, plan_name="Basic", monthly_price="10.00"),
                              dict(plan_id=2, plan_name="Premium", monthly_price="25.00")])
    return Tables({name: frame(spark, name, rows.get(name, [])) for name in SCHEMAS}, as_of)


def rows_of(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
