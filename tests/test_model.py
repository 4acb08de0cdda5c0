"""Evaluation, scores and tails against independent computations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast.functions.business import PRIORITY_LABELS
from holdfast.functions.pvalues import chi2_upper, t_two_sided
from holdfast.plans import churn_model as m


def predictions(spark, n: int = 600):
    rng = np.random.default_rng(3)
    churn = (rng.random(n) < 0.3).astype(int)
    # few distinct scores, so ties cross the labels
    p = np.clip(np.round(rng.normal(0.35 + 0.25 * churn, 0.15), 2), 0, 1)
    pdf = pd.DataFrame({"model": "M", "churn": churn, "prediction": (p > 0.5).astype(float), "p": p})
    return pdf, spark.createDataFrame(pdf)


def test_evaluation(spark):
    pdf, df = predictions(spark)
    got = m.evaluate(df).first()
    hit = ((pdf.churn == 1) & (pdf.prediction == 1)).sum()
    precision, recall = hit / (pdf.prediction == 1).sum(), hit / (pdf.churn == 1).sum()
    pos, neg = pdf.p[pdf.churn == 1].to_numpy(), pdf.p[pdf.churn == 0].to_numpy()
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    want = dict(accuracy=(pdf.churn == pdf.prediction).mean(), precision=precision, recall=recall,
                f1_score=2 * precision * recall / (precision + recall), roc_auc=auc)
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=6e-5), name


def test_roc_points(spark):
    pdf, df = predictions(spark)
    got = m.roc_points(df).toPandas().set_index("threshold")
    for threshold in got.index:
        said = pdf.p >= threshold
        assert got.loc[threshold, "tpr"] == pytest.approx(said[pdf.churn == 1].mean())
        assert got.loc[threshold, "fpr"] == pytest.approx(said[pdf.churn == 0].mean())


def test_confusion_sums_and_report(spark):
    pdf, df = predictions(spark)
    assert m.confusion(df).agg(F.sum("n")).first()[0] == len(pdf)
    report = m.class_report(df).toPandas().set_index("class")
    assert report["support"].sum() == len(pdf)
    assert report.loc["Churned", "support"] == pdf.churn.sum()


def test_split_is_exact_and_stratified(spark):
    rows = [(i, int(i % 5 == 0)) for i in range(1003)]
    got = m.with_split(spark.createDataFrame(rows, "customer_id long, churn int")).groupBy("churn", "split").count().collect()
    counts = {(r["churn"], r["split"]): r["count"] for r in got}
    n1 = sum(c for _, c in rows)
    assert counts[(1, "test")] == math.ceil(n1 * 0.25) and counts[(0, "test")] == math.ceil((1003 - n1) * 0.25)
    assert sum(counts.values()) == 1003


def test_class_weights_balance(spark):
    rows = [(i, int(i % 4 == 0)) for i in range(100)]
    got = m.with_class_weight(spark.createDataFrame(rows, "customer_id long, churn int")).groupBy("churn").agg(F.sum("weight")).collect()
    assert all(r[1] == pytest.approx(50.0) for r in got)


def scored(spark):
    rows = [
        (1, "Basic", "Monthly", 10.0, 0, 0.9, "High"), (2, "Basic", "Annual", 10.0, 0, 0.9, "High"),
        (3, "Basic", "Monthly", 50.0, 0, 0.5, "Medium"), (4, "Basic", "Annual", 20.0, 0, 0.5, "Medium"),
        (5, "Basic", "Monthly", 5.0, 0, 0.1, "Low"), (6, "Basic", "Monthly", 99.0, 1, 0.99, "High"),
    ]
    return spark.createDataFrame(rows, "customer_id long, plan_name string, billing_cycle string, monthly_price double, "
                                       "churn int, churn_probability double, risk_level string")


def test_worklist(spark):
    got = {r["customer_id"]: r for r in m.worklist(scored(spark)).collect()}
    # churned customers are not listed; the median yearly value of the rest is 60
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert [got[i]["retention_priority"] for i in (1, 2, 3, 4, 5)] == [
        PRIORITY_LABELS[0], PRIORITY_LABELS[1], PRIORITY_LABELS[2], PRIORITY_LABELS[3], PRIORITY_LABELS[3]]
    assert got[1]["annualized_revenue"] == 120.0 and got[1]["revenue_at_risk"] == 108.0


def test_planted_signal_is_found(spark):
    from pyspark.ml import Pipeline

    rng = np.random.default_rng(0)
    n = 400
    pdf = pd.DataFrame({c: rng.normal(size=n) for c in m.NUMERIC})
    pdf["churn"] = (pdf["recency_days"] + 0.3 * rng.normal(size=n) > 0.5).astype(int)
    for c in m.CATEGORICAL:
        pdf[c] = rng.choice(["a", "b"], n)
    df = m.with_class_weight(spark.createDataFrame(pdf))
    prepare = Pipeline(stages=m.preprocessing()).fit(df)
    ready = prepare.transform(df)
    for name, estimator in m.classifiers(n, trees=10).items():
        out = estimator.fit(ready).transform(ready).select(F.lit(name).alias("model"), "churn", "prediction", vector_to_array("probability")[1].alias("p"))
        assert m.evaluate(out).first()["roc_auc"] > 0.9
        assert out.where(~F.col("p").between(0, 1)).count() == 0
    # a category that training has not seen encodes to zeros
    odd = prepare.transform(df.limit(1).withColumn("plan_name", F.lit("never seen"))).first()["plan_name_is"]
    assert odd.toArray().tolist() == [0.0, 0.0]


def test_the_shipped_setting_once(spark, sf_dir):
    """300 trees on the smallest tables: one fit serves every consumer of the bundle."""
    from holdfast.plans import dashboards
    from holdfast.sources.tpch import clean_tables

    t = clean_tables(spark, sf_dir)
    fit = m.fitted(t)
    assert fit is m.fitted(t) and fit.models[m.FOREST].stages[1].getNumTrees == 300
    assert {r["model"] for r in m.metrics_report(t).collect()} == {m.LOGISTIC, m.FOREST}
    scores = m.scores(t).collect()
    assert len(scores) == t.customers.join(t.subscriptions, "customer_id").select("customer_id").distinct().count()
    tier = lambda p: "High" if p >= 0.7 else "Medium" if p >= 0.4 else "Low"
    assert all(0 <= r["churn_probability"] <= 1 and r["risk_level"] == tier(r["churn_probability"]) for r in scores)
    tiers = {r["risk_level"]: r["customers"] for r in m.risk_distribution(t).collect()}
    assert sum(tiers.values()) == len(scores)
    parts = {r["retention_priority"]: r["customers"] for r in m.priority_report(t).collect()}
    assert sum(parts.values()) == m.worklist_report(t).count() == m.revenue_at_risk_total(t).first()["active_customers"]
    assert dashboards.worklist_filtered(t).count() == parts.get(PRIORITY_LABELS[0], 0)
    assert clean_tables(spark, sf_dir).once("fit", lambda: None) is None  # other tables, other fit


def test_a_report_on_one_model_trains_no_other(spark, sf_dir):
    from holdfast.plans import model_checks
    from holdfast.sources.tpch import clean_tables

    t = clean_tables(spark, sf_dir)
    logistic = m.Fitted(t, trees=3)
    t = t.given(fit=logistic, split=logistic.table)
    assert m.logistic_report(t).count() == 1 and model_checks.optimality_check(t).count() > 0
    assert list(logistic.models) == [m.LOGISTIC]
    forest = m.Fitted(t, trees=3)
    t = t.given(fit=forest)
    assert m.forest_report(t).count() == 1 and model_checks.forest_walk_check(t).first()["differing"] == 0
    assert list(forest.models) == [m.FOREST]


def test_a_fit_has_as_many_partitions_as_cores(spark, sf_dir, monkeypatch):
    """Every partition sends the statistics of all nodes and unpacks the model, so partitions may not grow with the table."""
    from pyspark.ml.classification import LogisticRegression

    from holdfast.sources.tpch import clean_tables

    cores, seen = spark.sparkContext.defaultParallelism, []
    t = clean_tables(spark, sf_dir)
    t = t.given(split=m.split_features(t).repartition(5 * cores + 1).localCheckpoint())
    fit_model = LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, rows: seen.append((rows.rdd.getNumPartitions(), rows.count())) or fit_model(self, rows))
    n = m.split_features(t).where("split = 'train'").count()
    for most, partitions in ((m.FIT_ROWS, cores), (-(-n // (2 * cores)), 2 * cores)):
        monkeypatch.setattr(m, "FIT_ROWS", most)
        fit = m.Fitted(t, trees=3)
        rows = fit.probability(m.LOGISTIC, fit.table)
        assert seen.pop() == (partitions, n) and rows.count() == fit.table.count()
        assert rows.rdd.getNumPartitions() == partitions


# table values of the two distributions
@pytest.mark.parametrize("t,df,p", [(2.228, 10, 0.05), (2.845, 20, 0.01), (1.96, 1e6, 0.05), (12.706, 1, 0.05), (0.0, 5, 1.0)])
def test_t_tail(t, df, p):
    assert t_two_sided(t, df) == pytest.approx(p, rel=2e-3)
    assert t_two_sided(-t, df) == t_two_sided(t, df)


@pytest.mark.parametrize("x,df,p", [(3.841, 1, 0.05), (6.635, 1, 0.01), (9.488, 4, 0.05), (18.307, 10, 0.05), (0.0, 3, 1.0)])
def test_chi2_tail(x, df, p):
    assert chi2_upper(x, df) == pytest.approx(p, rel=2e-3)


def test_tails_agree_with_closed_forms():
    for x in (0.1, 1.0, 4.0, 30.0, 543.513):
        assert chi2_upper(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)
        assert chi2_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-9)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert t_two_sided(-70.857, 16000) < 1e-300
