"""Cumulative sums along a global order of unboundedly many distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from holdfast.operators.stable import stable


def running_totals(df: DataFrame, group: str, value: str, measures: Sequence[str], descending: bool = False) -> DataFrame:
    """Add ``cum_<measure>`` (inclusive) and ``all_<measure>`` per group; (group, value) must be unique.

    The rows are range-partitioned on (group, value). Sums inside a range plus the totals of the earlier
    ranges replace a window over the whole group, so no task sees more than its range.
    """
    order = [F.col(group).asc(), F.col(value).desc() if descending else F.col(value).asc()]
    ranged = stable(
        df.select(group, value, *measures)
        .repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    # one row per group and range partition
    blocks = ranged.groupBy(group, "_part").agg(*[F.sum(m).alias(f"_b_{m}") for m in measures])
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = blocks.select(
        group, "_part",
        *[F.coalesce(F.sum(f"_b_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_b_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    inside = Window.partitionBy(group, "_part").orderBy(order[1]).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_run_{m}": F.sum(m).over(inside) for m in measures})
    return local.join(offsets, [group, "_part"]).select(
        group, value, *measures,
        *[(F.col(f"_o_{m}") + F.col(f"_run_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"all_{m}" for m in measures],
    )
