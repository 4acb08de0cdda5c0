from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import mixing
from tests.llm import edges


@pytest.mark.parametrize("rate", [0.01, 0.7, 1.0, 13.5, 900.0, 250_000.0])
def test_table_is_the_poisson_distribution(rate):
    low, cdf = mixing.poisson_table(rate)
    pmf = np.diff(np.concatenate([[0.0], cdf]))
    k = np.arange(low, low + len(cdf))
    assert abs(cdf[-1] - 1) < 1e-6
    assert abs((pmf * k).sum() / rate - 1) < 1e-5
    some = int(rate)
    assert pmf[some - low] == pytest.approx(math.exp(some * math.log(rate) - rate - math.lgamma(some + 1)), rel=1e-6)


def test_shares_meet_the_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id < 15000 THEN 'big' WHEN id < 19000 THEN 'mid' ELSE 'out' END AS source",
                                          "repeat('x', int(1 + id % 7)) AS text")
    out = mixing.mix(docs, weights={"big": 1.0, "mid": 3.0}, total=100_000)
    got = {r["source"]: r["s"] for r in out.groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "s").collect()}
    size = {r["source"]: r["s"] for r in out.selectExpr("source", "length(text) AS l").groupBy("source").sum("l").withColumnRenamed("sum(l)", "s").collect()}
    assert set(got) == {"big", "mid"}
    assert size["big"] == pytest.approx(25_000, rel=0.05) and size["mid"] == pytest.approx(75_000, rel=0.05)


def test_counts_invert_the_distribution_at_the_hash(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "'s' AS source", "string(id) AS text")
    out = mixing.mix(docs, total=3 * 1390.0, seed=5)
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    import hashlib
    rate = 3 * 1390.0 / sum(len(str(i)) for i in range(500))
    for i in range(500):
        u = (int(hashlib.md5(f"5:{i}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        k, below = 0, math.exp(-rate)
        while below < u:
            k += 1
            below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        assert counts.get(i, 0) == k


def test_edges(spark):
    docs = edges.documents(spark)
    out = mixing.mix(docs, alpha=0.0, total=10_000_000)
    assert set(out.columns) == set(docs.columns)
    assert out.filter("source IS NULL").count() > 0 and out.filter("text IS NULL").count() > 0
    assert mixing.mix(edges.empty(spark)).collect() == []
    assert mixing.mix(docs, weights={"nowhere": 1.0}).collect() == []


def test_equal_rows_are_scattered(spark):
    docs = spark.createDataFrame([(1, "same", "a")] * 4000 + [(None, None, "a")] * 4000, "doc_id long, text string, source string").repartition(4)
    mixed = mixing.mix(docs, alpha=1.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["n"] for r in mixed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 8 and max(sizes) < 3 * sum(sizes) / len(sizes)
