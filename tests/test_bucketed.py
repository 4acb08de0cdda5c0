"""Cleaned tables saved for repeated use: reports at customer grain without a shuffle by customer."""

from __future__ import annotations

import re

import pytest

from holdfast.catalogue import BUSINESS
from holdfast.sources.schema import SCHEMAS
from holdfast.sources.tables import open_bucketed, write_bucketed
from holdfast.sources.tpch import clean_tables

REPORTS = ["q22_churn_by_region", "v01_customer_360", "r01_rfm_base"]


@pytest.fixture(scope="module")
def saved(spark, sf_dir, tmp_path_factory):
    t = clean_tables(spark, sf_dir)
    names = write_bucketed(t, str(tmp_path_factory.mktemp("bucketed")), "saved_", buckets=4)
    assert names == [f"saved_{name}" for name in SCHEMAS]
    yield t, open_bucketed(spark, "saved_", t.as_of)
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def shuffles(df) -> list[str]:
    """What the plan's rows are dealt out by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (hashpartitioning\(\w+)", plan)


@pytest.mark.parametrize("key", REPORTS)
def test_reports_need_no_shuffle_by_customer(spark, saved, key):
    t, stored = saved
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins of large tables
    try:
        few, many = shuffles(BUSINESS[key](stored)), shuffles(BUSINESS[key](t))
        assert "hashpartitioning(customer_id" not in few and len(few) < len(many), (few, many)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("key", REPORTS)
def test_results_are_the_same(saved, key):
    t, stored = saved
    rows = [sorted(map(str, BUSINESS[key](x).collect())) for x in (t, stored)]
    assert rows[0] == rows[1] and rows[0]


def test_a_bucket_is_one_sorted_file(spark, saved):
    per_file = saved[1].transactions.selectExpr("_metadata.file_path AS f", "customer_id").distinct().groupBy("customer_id").count()
    assert per_file.where("count > 1").count() == 0
    assert saved[1].transactions.selectExpr("_metadata.file_path AS f").distinct().count() == 4
