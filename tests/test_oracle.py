"""Every registered key runs; every key with SQL equals DuckDB on the same files."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import compare
from holdfast.catalogue import BUSINESS, RAW, SCORED
from holdfast.plans import churn_model
from holdfast.sources.tpch import clean_tables

# the training-data operators have tests of their own
KEYS = [*BUSINESS, *RAW, *SCORED]
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.fixture(scope="module", autouse=True)
def small_forest(spark, sf_dir):
    """Twenty trees are enough to exercise every report on the model."""
    t = clean_tables(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, entry._file_state(spark, sf_dir))
    entry.BUNDLES[key] = t.given(fit=churn_model.Fitted(t, trees=20), split=churn_model.split_features(t))
    yield
    entry.BUNDLES.clear()


@pytest.mark.parametrize("key", KEYS)
def test_key(spark, con, sf_dir, key):
    status, _, _ = compare.compare(spark, con, sf_dir, key)
    assert status == ("ok" if key in ORACLE else "rows-only")


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_only_model_and_tail_probabilities_lack_sql():
    without = {k for k in KEYS if k not in ORACLE}
    assert all(k[0] in "mkd" or k == "s04_test_report" for k in without), without
