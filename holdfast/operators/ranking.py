"""Exact global ranks without a single-partition window.

A window with no partitionBy moves every row to one task. Here the rows are
range-partitioned on the full sort key (ties are split by id, so one dominant
value still spreads), sorted inside the partitions, and the partition sizes turn
the local positions into global ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.operators.stable import stable

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row position below


def global_rank(df: DataFrame, order: list[Column | str], rank: str = "rank", total: str = "total") -> DataFrame:
    """Add the 1-based position in ``order`` (which must be unique) and the row count.

    Keep ``df`` narrow: its columns are range-shuffled and written to the checkpoint folder once.
    """
    # no fixed count: adaptive execution merges small neighbouring ranges, which keeps their order
    ordered = stable(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id())
    )
    part = F.shiftright("_pos", _ROW_BITS)
    row = F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # one row per range partition, so the window and the broadcast are bounded by spark.sql.shuffle.partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy()).alias(total),
    )
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_offset") + row + 1)
        .drop("_part", "_pos", "_offset")
    )


def ntile_of(rank: Column, total: Column, k: int) -> Column:
    """NTILE bucket of a rank: the first ``total mod k`` buckets hold one row more."""
    small = F.floor(total / k)
    large_rows = (total % k) * (small + 1)
    in_large = F.floor((rank - 1) / (small + 1)) + 1
    in_small = (total % k) + F.floor((rank - 1 - large_rows) / F.greatest(small, F.lit(1))) + 1
    return F.when(rank <= large_rows, in_large).otherwise(in_small).cast("int")


def qcut_of(rank: Column, total: Column, k: int) -> Column:
    """Bucket of a rank under linear-interpolated quantile cuts, closed on the right."""
    span = F.greatest(total - 1, F.lit(1))
    return F.greatest(F.floor((k * (rank - 1) + span - 1) / span), F.lit(1)).cast("int")


def ntile_exact(df: DataFrame, value: str, key: str, k: int, name: str, descending: bool = False) -> DataFrame:
    """(key, value, name): NTILE(k) over the whole frame ordered by value, ties by key."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    ranked = global_rank(df.select(key, value), [order, F.col(key).asc()])
    return ranked.select(key, value, ntile_of(F.col("rank"), F.col("total"), k).alias(name))


def qcut_label(df: DataFrame, value: str, key: str, k: int) -> Column:
    """Quantile bucket of first-come ranks (order by value, ties by key) as an expression over rows of ``df``.

    Only the last row of each bucket, at most k - 1 rows, comes back from the ranking. Rows are labelled by comparing
    them with those, so they are neither moved nor joined.
    """
    ranked = global_rank(df.select(key, value), [F.col(value).asc(), F.col(key).asc()])
    bucket, following = qcut_of(F.col("rank"), F.col("total"), k), qcut_of(F.col("rank") + 1, F.col("total"), k)
    # a handful of boundaries, like the splits a quantile discretiser is fitted to
    ends = (
        ranked.where((F.col("rank") < F.col("total")) & (bucket < following))
        .select(value, key, following.alias("following")).collect()
    )
    label = F.lit(1)
    for end in sorted(ends, key=lambda end: end["following"]):
        after = (F.col(value) > F.lit(end[value])) | ((F.col(value) == F.lit(end[value])) & (F.col(key) > F.lit(end[key])))
        label = F.when(after, F.lit(end["following"])).otherwise(label)
    return label
