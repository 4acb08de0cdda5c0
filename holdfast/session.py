"""Runtime settings the plans rely on; they change how a plan runs, never its result."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # merges small shuffle partitions, turns joins with a side measured to be small into broadcasts
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # splits a partition that holds a hot key, also where the following aggregate then needs its own shuffle
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
