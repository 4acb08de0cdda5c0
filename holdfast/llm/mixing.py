"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the output, measured in code points. Its mean repetition rate is the share times the
output size over the source's own size. A seeded hash of id and text gives each document a uniform number; inverting the
Poisson distribution of its source's rate at that number gives its count, the document is exploded by it, and all copies are
shuffled by a seeded hash of document and copy number.

Without explicit weights a source's target is its size to the power ``alpha`` (1: as it is, 0: all sources equal). With
weights, a source that is not named gets none. A null source is a source of its own. Null or empty texts have one code point
for this purpose, so that a source of them has a size. Repeated rows get the same count each. Extra columns are carried
along; an input column named ``copy`` is replaced where copies are numbered. An empty table gives an empty result.

The shuffle's hash also takes the row's place in the input, so that a row repeated very often is scattered too. Counts hang
on seed, id and text alone; the order of the output repeats for the same files and split size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import packed, quoted, unpacked
from holdfast.operators.stable import stable

#: the distribution tables of all sources are broadcast up to this many numbers (8 bytes each)
BROADCAST_CELLS = 2_000_000


def poisson_table(rate: float) -> tuple[int, np.ndarray]:
    """Where the cumulative distribution begins to matter, and its values from there until it is 1 in double precision."""
    if not rate > 0:
        return 0, np.ones(1)
    reach = 12 * math.sqrt(rate) + 40
    low, high = max(0, math.floor(rate - reach)), math.ceil(rate + reach)
    k = np.arange(low, high + 1)
    logs = np.cumsum(np.concatenate([[low * math.log(rate) - rate - math.lgamma(low + 1)], np.log(rate / k[1:])]))
    return low, np.cumsum(np.exp(logs))


def with_tables(rate_rows: DataFrame) -> DataFrame:
    """source and the table of its rate, one row per source."""

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells = [poisson_table(x) for x in frame["rate"]]
            yield pd.DataFrame({"source": frame["source"], "low": [a for a, _ in cells], "cdf": [b for _, b in cells]})

    return rate_rows.mapInPandas(fill, "source string, low long, cdf array<double>")


def uniform(seed: int, doc_id: Column, text: Column) -> tuple[Column, Column]:
    """A digest of seed, id and text, and the number in (0, 1) that its first 52 bits give."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return key, (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, alpha: float, weights: dict[str | None, float] | None, total: float | None, source: str, text: str) -> DataFrame:
    """source, rate: mean number of copies of a document of that source."""
    size = F.greatest(F.coalesce(F.char_length(quoted(text)), F.lit(0)), F.lit(1)).cast("long")
    # one row per source, read for its own rate and for the sums
    sizes = stable(docs.groupBy(quoted(source).cast("string").alias("source")).agg(F.sum(size).alias("size")))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        sizes = sizes.join(given, sizes["source"].eqNullSafe(given["source"]), "left").select(
            sizes["source"], "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = sizes.agg(F.struct(F.sum("size").alias("sizes"), F.sum("weight").alias("weights"))).scalar()
    out = F.lit(float(total)) if total is not None else sums.getField("sizes").cast("double")
    rate = F.col("weight") / sums.getField("weights") * out / F.col("size")
    return sizes.select("source", F.when(sums.getField("weights") > 0, rate).otherwise(0.0).alias("rate"))


def mix(
    docs: DataFrame, alpha: float = 0.5, weights: dict[str | None, float] | None = None, total: float | None = None,
    seed: int = 20240229, doc_id: str = "doc_id", source: str = "source", text: str = "text", numbered: bool = True,
) -> DataFrame:
    """The columns of ``docs`` and, if ``numbered``, ``copy`` (from 1), one row per copy, in shuffled order. ``total``: code
    points of the whole output, by default as many as come in."""
    tables = stable(with_tables(rates(docs, alpha, weights, total, source, text)))
    key, u = uniform(seed, quoted(doc_id), quoted(text))
    name = quoted(source).cast("string")
    rows = docs.select(packed(docs).alias("row"), name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("name"), key.alias("key"), u.alias("u"),
                       F.monotonically_increasing_id().alias("at"))
    known = tables.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "low", "cdf")
    cells = tables.agg(F.sum(F.size("cdf")).alias("n")).first()["n"] or 0
    if cells <= BROADCAST_CELLS:
        known = F.broadcast(known)
    below = F.size(F.filter(F.col("cdf"), lambda c: c < F.col("u")))
    # beyond the table's end the distribution is 1 but for rounding
    count = F.col("low") + F.least(below, F.size("cdf") - 1)
    counted = rows.join(known, ["none", "name"]).select("row", "key", "at", count.alias("count")).filter("count > 0")
    copies = counted.select("row", "key", "at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy"))
    placed = copies.withColumn("place", F.xxhash64(F.lit(seed), "key", "copy", "at"))
    shuffled = placed.repartition("place").sortWithinPartitions("place")
    return unpacked(shuffled, docs.columns, {"copy": F.col("copy")} if numbered else {})
