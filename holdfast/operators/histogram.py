"""Equal-width histograms computed where the data is: one pass for the range, one for the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """(by,) bin, bin_start, bin_end, n for non-empty bins; the range is common to all groups, the last bin closed."""
    x = F.col("_x")
    values = df.where(F.col(value).isNotNull()).select(*([by] if by else []), F.col(value).cast("double").alias("_x"))
    ends = values.agg(F.struct(F.min("_x").alias("a"), F.max("_x").alias("b")).alias("e")).scalar()
    low, high = ends.getField("a"), ends.getField("b")
    # numpy widens an empty range by half a unit on each side
    low, high = F.when(low == high, low - 0.5).otherwise(low), F.when(low == high, high + 0.5).otherwise(high)
    width = (high - low) / F.lit(float(bins))
    slot = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    return (
        values.groupBy(*([by] if by else []), slot.alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(
            *([by] if by else []), "bin",
            (low + F.col("bin") * width).alias("bin_start"),
            (low + (F.col("bin") + 1) * width).alias("bin_end"),
            "n",
        )
    )
