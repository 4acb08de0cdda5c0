"""Sources, sinks, views, integrity after cleaning, and the KPI filter context."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from builders import rows_of, tables
from holdfast.plans import cleaning, kpi, quality
from holdfast.sources.schema import SCHEMAS
from holdfast.sources.tables import read_tables, register_views, write_table
from holdfast.sources.tpch import clean_tables, raw_tables


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, sf_dir, tmp_path, fmt):
    t = clean_tables(spark, sf_dir)
    for name in SCHEMAS:
        write_table(t[name], f"{tmp_path}/{name}" + (".csv" if fmt == "csv" else ""), fmt)
    back = read_tables(spark, str(tmp_path), fmt, as_of=t.as_of)
    for name in SCHEMAS:
        assert back[name].schema == SCHEMAS[name]
        assert back[name].exceptAll(t[name].select(*SCHEMAS[name].names)).count() == 0
        assert back[name].count() == t[name].count()


def test_first_occurrence_follows_the_file(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    head = ",".join(SCHEMAS["customers"].names)
    lines = [f"{i % 50},2000-01-01,Male,{20 + i // 50},France,EUROPE,Direct,Other" for i in range(100)]
    (folder / "customers.csv").write_text("\n".join([head, *lines]) + "\n")
    t = read_tables(spark, str(folder), "csv", ingest_order=True)
    ages = cleaning.keep_first(t.customers, ["customer_id"], ["ingest_ord"]).select("age").distinct().collect()
    assert [r["age"] for r in ages] == [20]
    assert cleaning.clean_customers(t).table().count() == 50


def test_json_sink(spark, tmp_path):
    write_table(spark.range(1).select(F.struct(F.lit(1).alias("x")).alias("s")), f"{tmp_path}/out", "json")
    text = spark.read.text(f"{tmp_path}/out").first()[0]
    assert json.loads(text) == {"s": {"x": 1}}


def test_views(spark, sf_dir):
    t = clean_tables(spark, sf_dir)
    names = register_views(t, prefix="hf_")
    assert len(names) == 9
    got = spark.sql("SELECT COUNT(*) AS n, SUM(is_churned) AS c FROM hf_customer_360").first()
    assert got["n"] == t.customers.count() and got["c"] > 0


def test_cleaned_tables_pass_the_integrity_statements(spark, sf_dir):
    done = cleaning.clean_all(raw_tables(spark, sf_dir))
    # cleaning has no rule for subscriptions of unknown customers: they stay and stay reported
    assert quality.orphan_subscriptions(done).count() == quality.orphan_subscriptions(raw_tables(spark, sf_dir)).count() > 0
    for check in (quality.duplicate_customers, quality.orphan_transactions,
                  quality.cancelled_without_date, quality.end_before_start, quality.negative_charges, quality.age_bounds):
        assert check(done).count() == 0, check.__name__
    assert quality.check_constraints(done).agg(F.sum("violations")).first()[0] == 0
    orphans = quality.foreign_keys(done).where("NOT (child = 'subscriptions' AND child_column = 'customer_id')")
    assert orphans.agg(F.sum("orphans")).first()[0] == 0
    assert rows_of(quality.null_audit(done)) == [{"null_gender": 0, "null_country": 0, "null_age": 0}]


def test_whole_source_tables_are_mapped(spark, sf_dir):
    t = clean_tables(spark, sf_dir)
    rows = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    assert t.subscriptions.count() == rows("orders") and t.transactions.count() == rows("lineitem")
    assert t.activity.count() + t.tickets.count() == rows("events") and t.customers.count() == rows("customer")


@pytest.fixture(scope="module")
def small(spark):
    return tables(
        spark,
        customers=[dict(customer_id=1, region="ASIA"), dict(customer_id=2, region="EUROPE"), dict(customer_id=3, region="EUROPE")],
        subscriptions=[
            dict(subscription_id=1, customer_id=1, plan_id=1, monthly_price="10.00"),
            dict(subscription_id=2, customer_id=2, plan_id=1, billing_cycle="Annual", monthly_price="24.00"),
            dict(subscription_id=3, customer_id=2, plan_id=2, monthly_price="30.00", start_date="2000-05-01"),
        ],
        transactions=[
            dict(transaction_id=1, customer_id=1, subscription_id=1, amount="5.00", transaction_date="2000-01-15"),
            dict(transaction_id=2, customer_id=2, subscription_id=2, amount="7.00", transaction_date="2000-02-15"),
            dict(transaction_id=3, customer_id=2, subscription_id=3, amount="11.00", transaction_date="2000-02-16"),
            dict(transaction_id=4, customer_id=2, subscription_id=3, amount="99.00", payment_status="Failed"),
        ],
    )


def one(df, name):
    return {tuple(r[c] for c in df.columns if c != name): r[name] for r in df.collect()}


def test_kpi_totals(small):
    assert kpi.kpi(small, "churn_rate").first()[0] == pytest.approx(1 / 3)
    assert kpi.kpi(small, "mrr").first()[0] == 42.0
    assert kpi.kpi(small, "arpu").first()[0] == pytest.approx(23 / 3)
    assert kpi.kpi(small, "clv").first()[0] == pytest.approx(23 / 2)


def test_kpi_by_attributes(small):
    assert one(kpi.kpi(small, "churn_rate", ["region"]), "churn_rate") == {("ASIA",): 0.0, ("EUROPE",): 0.5}
    assert one(kpi.kpi(small, "total_revenue", ["plan_name"]), "total_revenue") == {("Basic",): 12.0, ("Premium",): 11.0}
    # a customer with two plans counts once in total and once per plan
    assert one(kpi.kpi(small, "active_customers", ["plan_name"]), "active_customers") == {("Basic",): 2, ("Premium",): 1}
    assert kpi.kpi(small, "active_customers").first()[0] == 2
    assert one(kpi.kpi(small, "mrr", ["billing_cycle", "region"]), "mrr") == {
        ("Monthly", "ASIA"): 10.0, ("Annual", "EUROPE"): 2.0, ("Monthly", "EUROPE"): 30.0}


def test_kpi_filters(small):
    europe = kpi.kpi(small, "total_revenue", where=F.col("region") == "EUROPE", where_uses=["region"])
    assert europe.first()[0] == 18.0
    february = kpi.kpi(small, "total_revenue", start=dt.date(2000, 2, 1), end=dt.date(2000, 2, 15))
    assert february.first()[0] == 7.0
    by_month = kpi.kpi(small, "total_revenue", ["month"])
    assert one(by_month, "total_revenue") == {(dt.date(2000, 1, 1),): 5.0, (dt.date(2000, 2, 1),): 18.0}


def test_kpi_base_total_stands_in_every_group(small):
    """Customers have no path to a plan, and only signups to a date."""
    total = kpi.kpi(small, "total_customers").first()[0]
    by_plan = one(kpi.kpi(small, "total_customers", ["plan_name"]), "total_customers")
    assert set(by_plan.values()) == {total} and (None,) not in by_plan
    active = one(kpi.kpi(small, "active_customers", ["plan_name"]), "active_customers")
    churned = one(kpi.kpi(small, "churned_customers", ["plan_name"]), "churned_customers")
    assert churned == {p: total - n for p, n in active.items()}
    rate = one(kpi.kpi(small, "churn_rate", ["month"]), "churn_rate")
    assert all(0 <= r <= 1 for r in rate.values()) and (None,) not in rate
    revenue = one(kpi.kpi(small, "total_revenue", ["plan_name"]), "total_revenue")
    assert one(kpi.kpi(small, "arpu", ["plan_name"]), "arpu") == {p: r / total for p, r in revenue.items()}


def test_kpi_slicer_on_an_unrelated_fact_leaves_it_whole(small):
    whole = kpi.kpi(small, "avg_sessions").first()[0]
    assert kpi.kpi(small, "avg_sessions", where=F.col("plan_name") == "Basic", where_uses=["plan_name"]).first()[0] == whole
    assert set(one(kpi.kpi(small, "avg_sessions", ["plan_name"]), "avg_sessions").values()) == {whole}


def test_kpi_cancellation_date_role(small):
    by_start = kpi.kpi(small, "revenue_lost", ["month"]).where("revenue_lost > 0").collect()
    by_end = kpi.kpi(small, "revenue_lost", ["month"], subscription_date="cancellation_date").collect()
    assert sum(r["revenue_lost"] for r in by_start) == sum(r["revenue_lost"] for r in by_end)


def test_risk_sweep_totals(spark, sf_dir):
    from holdfast.plans import churn_model

    t = churn_model.with_fixed_formula(clean_tables(spark, sf_dir))
    n = churn_model.scores(t).count()
    assert kpi.risk_level_sweep(t).count() == 81 * 3
    totals = kpi.risk_level_sweep(t).groupBy("high", "medium").agg(F.sum("customers").alias("n"))
    assert {r["n"] for r in totals.collect()} == {n}
    high = kpi.risk_level_sweep(t).where("risk_level = 'High' AND medium = 0.2").orderBy("high").collect()
    assert all(a["customers"] >= b["customers"] for a, b in zip(high, high[1:]))


def test_csv_keeps_whole_numbers_written_as_decimals(spark, tmp_path):
    """Integer columns of the files carry ``34.0`` once a value of the column was missing."""
    from holdfast.plans import cleaning
    from holdfast.sources.tables import unreadable

    for name, schema in SCHEMAS.items():
        (tmp_path / f"{name}.csv").write_text(",".join(schema.names) + "\n")
    head = ",".join(SCHEMAS["customers"].names)
    (tmp_path / "customers.csv").write_text(
        f"{head}\n1,2020-01-01,Male,34.0,X,ASIA,Web,App\n2,2020-01-02 00:00:00,Male,,X,ASIA,Web,App\n"
        "3,2020-01-03,Male,old,X,ASIA,Web,App\n4,soon,Male,40,X,ASIA,Web,App\n5.0,2020-01-05,Male,20.5,X,ASIA,Web,App\n")
    head = ",".join(SCHEMAS["customer_activity"].names)
    (tmp_path / "customer_activity.csv").write_text(f"{head}\n1,1,2020-02-01,3.0,12.0,1.0,7.0\n2,1,2020-02-01,3,,1,\n")
    t = read_tables(spark, str(tmp_path))
    ages = {r["customer_id"]: r["age"] for r in t.customers.collect()}
    assert ages == {1: 34, 2: None, 3: None, 4: 40, 5: None}
    assert [r["signup_date"] is None for r in t.customers.orderBy("customer_id").collect()] == [False, False, False, True, False]
    usage = t.activity.orderBy("activity_id").collect()
    assert [(r["session_minutes"], r["feature_usage_count"]) for r in usage] == [(12, 7), (None, None)]
    lost = {(r["table_name"], r["column_name"]): (r["unreadable"], r["example"]) for r in unreadable(spark, str(tmp_path)).collect()}
    assert lost == {("customers", "age"): (2, "20.5"), ("customers", "signup_date"): (1, "soon")}
    clean = {r["customer_id"]: r["age"] for r in cleaning.clean_customers(t).table().collect()}
    assert clean[1] == 34 and clean[4] == 40 and clean[3] is not None
