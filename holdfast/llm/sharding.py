"""Two-pass external shuffle of a document table into shards of equal row counts.

Pass one scatters rows into memory-sized buckets by a seeded hash; the exchange is the external storage. Pass two takes one
bucket at a time, permutes it with a seeded Fisher-Yates shuffle and writes it. A row's place in the total order is the
size of the buckets before its own plus its place in the bucket; shard and slot are that place modulo and divided by the
number of shards, so counts differ by one at most and slots have no gap.

Nulls in any column, empty texts and repeated rows are rows like any other. The hash also takes the number of the input
partition, so that a row repeated very often is scattered too. Within a bucket rows are first sorted by that hash: the same
seed, files and split size give the same order, whichever executor does the work and however often. An input column named
``shard`` or ``slot`` is replaced. An empty table gives an empty one with the same columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import packed, prepare, quoted, unpacked, written

#: at most this many buckets, which grow instead: their offsets (24 bytes each) are broadcast
MAX_BUCKETS = 1_000_000
#: buckets of one task, on average
TASK_BUCKETS = 4


def permute(bucket: int, hashes: np.ndarray, seed: int) -> np.ndarray:
    """Row numbers of a bucket in shuffled order: canonical order by hash, then Fisher-Yates."""
    order = np.argsort(hashes, kind="stable")
    rng = np.random.default_rng([seed, bucket])
    rng.shuffle(order)  # numpy's shuffle is Fisher-Yates, in place
    return order


def shuffled(docs: DataFrame, seed: int, bucket_bytes: int, doc_id: str, text: str) -> DataFrame:
    """The written buckets: row, bucket, pos."""
    # 64: what a row takes beside its text
    total = docs.agg(F.sum(F.coalesce(F.octet_length(quoted(text)), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    n_buckets = min(max(1, math.ceil(total / bucket_bytes)), MAX_BUCKETS)
    mix = F.xxhash64(F.lit(seed), quoted(doc_id), quoted(text), F.spark_partition_id())
    scattered = docs.select(packed(docs).alias("row"), mix.alias("mix")).withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), "mix"), F.lit(n_buckets)).cast("int")
    )
    out = scattered.select("row", "bucket", F.lit(0).alias("pos")).schema
    arrow_names = [f.name for f in out]

    def one_bucket(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        order = permute(bucket, rows.column("mix").to_numpy(), seed)
        moved = rows.select(["row", "bucket"]).take(pa.array(order))
        return moved.append_column("pos", pa.array(np.arange(len(order), dtype=np.int32))).select(arrow_names)

    # as many partitions as the buckets ask for, so that a task's share does not grow with the input
    partitions = min(n_buckets, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_buckets // TASK_BUCKETS))
    dealt = scattered.repartition(partitions, "bucket")
    return written(dealt.groupBy("bucket").applyInArrow(one_bucket, out), "buckets")


def shard(
    docs: DataFrame, n_shards: int = 16, seed: int = 20240229, bucket_bytes: int = 8 << 20,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` (int, from 0) and ``slot`` (long, from 0 without a gap in each shard). Buckets
    have about ``bucket_bytes``; from 8 TB on, MAX_BUCKETS of them are larger (100 MB each at 100 TB)."""
    prepare(docs.sparkSession)
    buckets = shuffled(docs, seed, bucket_bytes, doc_id, text)
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    # one narrow row per bucket, not per document
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.col("offset") + F.col("pos")
    return unpacked(buckets.join(F.broadcast(offsets), "bucket"), docs.columns, {
        "shard": (place % n_shards).cast("int"), "slot": F.floor(place / n_shards).cast("long"),
    })


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows of a file in slot order."""
    parts = sharded.repartition("shard").sortWithinPartitions("shard", "slot")
    parts.write.partitionBy("shard").parquet(path)
