"""Integrity statements: row counts, orphans, rule violations, domains, keys (dq01-dq13).

They report violations of whatever tables they are given; on cleaned tables the
violation lists are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from holdfast.functions.business import CANCELLED, CHARGE
from holdfast.operators.audit import orphans
from holdfast.sources.schema import FOREIGN_KEYS, REQUIRED_COLUMNS, SCHEMAS, domain_checks
from holdfast.sources.tables import Tables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(t: Tables) -> DataFrame:
    return _union([
        t[name].agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name in SCHEMAS
    ])


def duplicate_customers(t: Tables) -> DataFrame:
    return t.customers.groupBy("customer_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def orphan_subscriptions(t: Tables) -> DataFrame:
    return orphans(t.subscriptions, "customer_id", t.customers).select("subscription_id")


def orphan_transactions(t: Tables) -> DataFrame:
    return orphans(t.transactions, "subscription_id", t.subscriptions).select("transaction_id")


def cancelled_without_date(t: Tables) -> DataFrame:
    broken = (F.col("subscription_status") == CANCELLED) & F.col("cancellation_date").isNull()
    return t.subscriptions.where(broken).select("subscription_id")


def end_before_start(t: Tables) -> DataFrame:
    return t.subscriptions.where(F.col("end_date") < F.col("start_date")).select("subscription_id")


def negative_charges(t: Tables) -> DataFrame:
    """SQL comparison: a row without a payment status is not reported (the cleaning step does repair it)."""
    broken = (
        (F.col("transaction_type") == CHARGE) & (F.col("amount") < 0) & (F.col("payment_status") != "Refunded")
    )
    return t.transactions.where(broken).select("transaction_id")


def age_bounds(t: Tables) -> DataFrame:
    return t.customers.where((F.col("age") < 13) | (F.col("age") > 100)).select("customer_id", "age")


def null_audit(t: Tables) -> DataFrame:
    return t.customers.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("gender", "country", "age")])


def distinct_values(table: str, column: str):
    return lambda t: t[table].select(column).distinct().orderBy(column)


def check_constraints(t: Tables) -> DataFrame:
    """(table_name, check_name, violations): one aggregate per table evaluates all its rules."""
    frames = []
    for table, required in REQUIRED_COLUMNS.items():
        rules = {f"{c}_not_null": F.col(c).isNull() for c in required} | domain_checks().get(table, {})
        counts = t[table].agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
        rows = [F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in rules]
        frames.append(counts.select(F.lit(table).alias("table_name"), F.inline(F.array(*rows))))
    return _union(frames)


def foreign_keys(t: Tables) -> DataFrame:
    """(child, child_column, parent, orphans). Child keys are counted first, so a hot key joins as one row."""
    frames = []
    for child, child_key, parent, parent_key in FOREIGN_KEYS:
        used = t[child].where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
        missing = used.join(t[parent].select(F.col(parent_key).alias("k")), "k", "left_anti")
        frames.append(missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(
            F.lit(child).alias("child"), F.lit(child_key).alias("child_column"), F.lit(parent).alias("parent"), "orphans"
        ))
    return _union(frames)


def duplicate_keys(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(relation, repeated_keys) for every relation that must have one row per key."""
    return _union([
        df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
        .select(F.lit(name).alias("relation"), "repeated_keys")
        for name, (df, key) in frames.items()
    ])


def dimension_grain(t: Tables) -> DataFrame:
    return duplicate_keys({
        "customers": (t.customers, "customer_id"),
        "plans": (t.plans, "plan_id"),
        "subscriptions": (t.subscriptions, "subscription_id"),
        "marketing_campaigns": (t.campaigns, "campaign_id"),
    })
