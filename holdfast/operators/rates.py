"""Counts, shares and churn rates by a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.functions.scalars import pct
from holdfast.functions.business import is_cancelled


def count_by(df: DataFrame, key: str, n: str = "customers") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(n))


def share_of_total(df: DataFrame, part: str, name: str = "pct_of_total", digits: int = 2) -> DataFrame:
    """Add the share of ``part`` in its sum over all rows. ``df`` is already at dimension grain (a few rows)."""
    everything = Window.partitionBy()
    return df.withColumn(name, pct(F.col(part), F.sum(part).over(everything), digits))


def churn_rate_by(df: DataFrame, key: Column | str, total: str = "customers") -> DataFrame:
    """Total, churned and churn_rate_pct per ``key`` of rows carrying subscription_status."""
    return (
        df.groupBy(key).agg(F.count("*").alias(total), F.sum(is_cancelled()).alias("churned"))
        .withColumn("churn_rate_pct", pct("churned", total))
    )


def churn_rate_from_counts(df: DataFrame, key: Column | str, total: str = "total_subs") -> DataFrame:
    """The same from rows that already carry partial counts ``n`` and ``cancelled``."""
    return (
        df.groupBy(key).agg(F.sum("n").alias(total), F.sum("cancelled").alias("churned"))
        .withColumn("churn_rate_pct", pct("churned", total))
    )
