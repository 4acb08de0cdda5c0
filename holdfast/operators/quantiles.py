"""Exact interpolated quantiles of columns with an unbounded number of distinct values.

The built-in ``percentile`` merges one value->count map per group in one task. It
is used directly where the domain is bounded (ages, scores, whole days); this
module is for the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.operators.running import running_totals


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: str | None = None) -> DataFrame:
    """One row (per ``by`` value) with columns q0, q1, ...; NULL values are ignored.

    Equal values are counted map-side first; running counts over the distinct values then place each
    of them in the sorted order.
    """
    group = F.col(by) if by else F.lit(0)
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(group.alias("g"), F.col(value).alias("v"))
        .agg(F.count("*").alias("n"))
    )
    placed = running_totals(counts, "g", "v", ["n"])

    def at(index: Column) -> Column:
        # smallest value whose cumulative count passes the 0-based index
        return F.min(F.when(F.col("cum_n") > index, F.col("v").cast("double")))

    spots = [F.lit(float(p)) * (F.col("all_n") - 1) for p in probs]
    aggs = []
    for i, spot in enumerate(spots):
        aggs += [at(F.floor(spot)).alias(f"lo{i}"), at(F.floor(spot) + 1).alias(f"hi{i}")]
    ends = placed.groupBy("g").agg(F.max("all_n").alias("all_n"), *aggs)
    results = []
    for i, spot in enumerate(spots):
        low, high = F.col(f"lo{i}"), F.coalesce(f"hi{i}", f"lo{i}")
        results.append((low + (high - low) * (spot - F.floor(spot))).alias(f"q{i}"))
    return ends.select(*([F.col("g").alias(by)] if by else []), *results)


def exact_median(df: DataFrame, value: str) -> Column:
    """The median as a scalar subquery, usable in any expression."""
    return exact_quantiles(df, value, [0.5]).select("q0").scalar()
