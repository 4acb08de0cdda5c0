"""Definitions every report shares: recognised revenue, churn, recurring value, risk tiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Categories, thresholds and labels of the published definitions.
CHARGE = "Subscription Charge"
SUCCESS = "Success"
ACTIVE = "Active"
CANCELLED = "Cancelled"
UNRESOLVED = "Closed - Unresolved"
HIGH_RISK = 0.70
MEDIUM_RISK = 0.40
PRIORITY_LABELS = (
    "Priority 1 - High Risk / High Value",
    "Priority 2 - High Risk / Medium-Low Value",
    "Priority 3 - Medium Risk / High Value",
    "Priority 4 - Low Risk",
)


def recognised() -> Column:
    """Rows that count as revenue."""
    return (F.col("transaction_type") == CHARGE) & (F.col("payment_status") == SUCCESS)


def is_cancelled(status: str = "subscription_status") -> Column:
    """1 or 0; a missing status is 0."""
    return F.when(F.col(status) == CANCELLED, 1).otherwise(0)


def is_active(status: str = "subscription_status") -> Column:
    return F.when(F.col(status) == ACTIVE, 1).otherwise(0)


def annualised(price: str = "monthly_price", cycle: str = "billing_cycle", annual_price_is_yearly: bool = True) -> Column:
    """Yearly recurring value. An annual price already is the yearly value unless told otherwise."""
    yearly = F.col(price) if annual_price_is_yearly else F.col(price) * 12
    return F.when(F.col(cycle) == "Monthly", F.col(price) * 12).otherwise(yearly)


def risk_tier(p: Column, high: float | Column = HIGH_RISK, medium: float | Column = MEDIUM_RISK) -> Column:
    return F.when(p >= high, "High").when(p >= medium, "Medium").otherwise("Low")


def priority_tier(p: Column, high_value: Column, high: float = HIGH_RISK, medium: float = MEDIUM_RISK) -> Column:
    """Outreach order. Medium risk with low value falls into the last tier."""
    risky = p >= high
    return (
        F.when(risky & high_value, PRIORITY_LABELS[0])
        .when(risky, PRIORITY_LABELS[1])
        .when((p >= medium) & high_value, PRIORITY_LABELS[2])
        .otherwise(PRIORITY_LABELS[3])
    )
