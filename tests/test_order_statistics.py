"""Exact ranks, tiles, quantiles and running sums against brute force, with heavy ties."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.operators.quantiles import exact_quantiles
from holdfast.operators.ranking import global_rank, ntile_exact, qcut_label
from holdfast.operators.running import running_totals


def sample(n: int, seed: int = 1) -> pd.DataFrame:
    """A third of all rows share one value."""
    rng = np.random.default_rng(seed)
    value = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 40, n))
    return pd.DataFrame({"id": rng.permutation(n).astype("int64"), "v": value.astype("int64")})


def ntile(n: int, k: int) -> list[int]:
    return [tile + 1 for tile in range(k) for _ in range(n // k + (tile < n % k))]


def test_global_rank_is_the_sorted_position(spark):
    pdf = sample(2000)
    got = global_rank(spark.createDataFrame(pdf), ["v", "id"]).toPandas().sort_values(["v", "id"])
    assert got["rank"].tolist() == list(range(1, 2001))
    assert set(got["total"]) == {2000}


@pytest.mark.parametrize("n,k", [(1, 4), (3, 4), (7, 5), (10, 3), (101, 10), (1000, 4)])
@pytest.mark.parametrize("descending", [False, True])
def test_ntile(spark, n, k, descending):
    pdf = sample(n)
    got = ntile_exact(spark.createDataFrame(pdf), "v", "id", k, "tile", descending).toPandas()
    got = got.sort_values(["v", "id"], ascending=[not descending, True])
    assert got["tile"].tolist() == ntile(n, k)


def qcut(df, k):
    return df.select("id", qcut_label(df, "v", "id", k).alias("q")).orderBy("id").toPandas()


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 8, 9, 23, 500])
def test_qcut_equals_pandas(spark, n):
    pdf = sample(n).sort_values(["v", "id"]).reset_index(drop=True)
    want = pd.qcut(pdf["v"].rank(method="first"), 5, labels=False) + 1
    got = qcut(spark.createDataFrame(pdf), 5).set_index("id")["q"]
    assert got.reindex(pdf["id"]).tolist() == want.tolist()


def test_seven_ranks_are_not_ntile(spark):
    pdf = pd.DataFrame({"id": range(7), "v": range(7)})
    assert qcut(spark.createDataFrame(pdf), 5)["q"].tolist() == [1, 1, 2, 3, 4, 5, 5]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1001])
def test_quantiles(spark, n):
    pdf = sample(n)
    df = spark.createDataFrame(pdf).withColumn("x", F.col("v") / 7).union(
        spark.createDataFrame([(-1, 0, None)], "id long, v long, x double"))
    probs = [0.0, 0.25, 0.5, 0.98, 1.0]
    got = exact_quantiles(df, "x", probs).first()
    assert [got[f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(pdf["v"] / 7, probs).tolist(), rel=1e-12, abs=1e-12)


def test_quantiles_by_group(spark):
    pdf = sample(900).assign(g=lambda d: np.where(d["id"] % 10 < 7, "big", "small"))
    got = exact_quantiles(spark.createDataFrame(pdf), "v", [0.5, 0.9], by="g").toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.5, 0.9]).unstack()
    assert np.allclose(got.loc[want.index, ["q0", "q1"]], want)


def test_quantile_of_nothing_is_empty(spark):
    df = spark.createDataFrame([(1, None)], "id long, x double")
    assert exact_quantiles(df, "x", [0.5]).count() == 0


def test_running_totals(spark):
    pdf = sample(800).groupby("v").size().rename("n").reset_index().assign(g=1)
    got = running_totals(spark.createDataFrame(pdf), "g", "v", ["n"], descending=True).toPandas().sort_values("v", ascending=False)
    assert got["cum_n"].tolist() == pdf.sort_values("v", ascending=False)["n"].cumsum().tolist()
    assert set(got["all_n"]) == {800}


def test_no_single_partition_window_at_customer_grain(spark):
    """The rank needs no window that gathers the ranked rows in one task."""
    plan = global_rank(spark.createDataFrame(sample(100)), ["v", "id"])._jdf.queryExecution().toString()
    assert "row_number" not in plan
