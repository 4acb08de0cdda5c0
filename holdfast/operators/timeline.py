"""Month series: gap filling and running totals. All frames here have one row per month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from holdfast.functions.scalars import month_start


def by_month(df: DataFrame, date: str, **aggs) -> DataFrame:
    """One row per calendar month (column ``month``, its first day) that has data."""
    return (
        df.where(F.col(date).isNotNull()).groupBy(month_start(date).alias("month"))
        .agg(*[agg.alias(name) for name, agg in aggs.items()])
    )


def month_spine(monthly: DataFrame) -> DataFrame:
    """Every month from the first to the last of ``monthly``."""
    ends = monthly.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    return ends.where(F.col("a").isNotNull()).select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month")
    )


def fill_months(monthly: DataFrame, *measures: str) -> DataFrame:
    """Months without data get zeros."""
    return month_spine(monthly).join(monthly, "month", "left").select(
        "month", *[F.coalesce(m, F.lit(0)).alias(m) for m in measures]
    )


def running(monthly: DataFrame, measure: str, name: str) -> DataFrame:
    window = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.withColumn(name, F.sum(measure).over(window))
