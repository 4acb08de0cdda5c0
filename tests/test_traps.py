"""Semantics that are easy to get wrong, each on a few rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from builders import frame, rows_of, tables
from holdfast.functions.bands import bands_left, bands_right
from holdfast.functions.business import annualised, risk_tier
from holdfast.functions.scalars import dec_round, is_all_lower, is_all_upper, safe_divide, title_case
from holdfast.operators.customer_grain import latest_subscription
from holdfast.plans import association, behaviour, churn, cleaning, cohorts, customer_view, dashboards, exploration, features, revenue

REACTIVATED = [
    dict(subscription_id=1, customer_id=1, start_date="2000-01-01", end_date="2000-06-01", cancellation_date="2000-06-01",
         subscription_status="Cancelled"),
    dict(subscription_id=2, customer_id=1, start_date="2000-09-01"),
]


def test_reactivation(spark):
    t = tables(spark, customers=[dict(customer_id=1)], subscriptions=REACTIVATED)
    latest = latest_subscription(t.subscriptions).first()
    assert latest["subscription_status"] == "Active" and latest["cancellation_date"] is None
    assert association.stat_base(t).first()["tenure_days"] == 365
    assert cohorts.retention_by_cohort(t).first()["still_active"] == 1
    kept = {r["milestone"]: r["retained"] for r in cohorts.cohort_long(t).collect()}
    assert kept["M3"] == 1 and kept["M6"] == 0


def test_start_date_tie_goes_to_higher_id(spark):
    t = tables(spark, customers=[dict(customer_id=1)], subscriptions=[
        dict(subscription_id=5, customer_id=1, plan_id=2), dict(subscription_id=3, customer_id=1, plan_id=1)])
    assert latest_subscription(t.subscriptions, "plan_id").first()["plan_id"] == 2
    assert features.observation_window(t).first()["plan_id"] == 1


@pytest.mark.parametrize("raw,want", [("non-binary", "Non-Binary"), ("UNITED STATES", "United States"), (" male ", "Male"), (None, None)])
def test_title_case(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(title_case("x").alias("y")).first()["y"] == want


def test_letter_case_tests_need_letters(spark):
    df = spark.createDataFrame([("ABC-1",), ("123",), ("abc",), (None,)], "x string")
    got = df.select(is_all_upper("x").alias("u"), is_all_lower("x").alias("l")).collect()
    assert [(r["u"], r["l"]) for r in got] == [(True, False), (False, False), (False, True), (None, None)]


def test_customer_without_ticket_is_in_the_zero_band(spark):
    t = tables(spark, customers=[dict(customer_id=1)], subscriptions=[dict(subscription_id=1, customer_id=1)])
    assert rows_of(churn.churn_by_tickets(t))[0]["ticket_volume_band"] == "1 - No tickets"


def test_no_customer_falls_out_of_the_chart_bands(spark):
    """101 tickets are many, and an age or discount no band foresees is still a customer."""
    t = tables(
        spark, customers=[dict(customer_id=1, age=140), dict(customer_id=2, age=30)],
        subscriptions=[dict(subscription_id=1, customer_id=1, discount_percentage=-5), dict(subscription_id=2, customer_id=2)],
        support_tickets=[dict(ticket_id=i, customer_id=1) for i in range(101)],
    )
    n = lambda df, key: {r[key]: r["customers"] for r in df.collect()}
    assert n(exploration.churn_by_ticket_band(t), "ticket_band") == {"5+": 1, "0": 1}
    assert n(exploration.churn_by_age_band(t), "age_group") == {"out of range": 1, "25-34": 1}
    assert n(exploration.churn_by_discount_band(t), "disc_band") == {"out of range": 1, "0%": 1}


def test_age_25_depends_on_the_closed_side(spark):
    t = tables(spark, customers=[dict(customer_id=1, age=25)], subscriptions=[dict(subscription_id=1, customer_id=1)])
    assert churn.churn_by_age(t).first()["age_group"] == "2 - 25-34"
    assert exploration.churn_by_age_band(t).first()["age_group"] == "<25"


def test_missing_age_counts_in_the_last_band(spark):
    t = tables(spark, customers=[dict(customer_id=1, age=None)], subscriptions=[dict(subscription_id=1, customer_id=1)])
    assert churn.churn_by_age(t).first()["age_group"] == "5 - 60+"
    assert exploration.churn_by_age_band(t).count() == 0


def test_bands(spark):
    df = spark.createDataFrame([(0,), (2,), (3,), (None,), (101,)], "x int")
    left = [r[0] for r in df.select(bands_left(F.col("x"), (2, 3), ("a", "b", "c"))).collect()]
    right = [r[0] for r in df.select(bands_right(F.col("x"), (-1, 0, 2, 100), ("a", "b", "c"))).collect()]
    opened = [r[0] for r in df.select(bands_right(F.col("x"), (None, 0, 2, None), ("a", "b", "c"))).collect()]
    assert opened == ["a", "b", "c", None, "c"]
    assert left == ["a", "b", "c", "c", "c"] and right == ["a", "b", "c", None, "out of range"]


def test_month_end_is_clamped(spark):
    t = tables(spark, customers=[dict(customer_id=1)], subscriptions=[dict(
        subscription_id=1, customer_id=1, start_date="2000-01-31", end_date="2000-02-29", cancellation_date="2000-02-29",
        subscription_status="Cancelled")])
    kept = {r["milestone"]: r["retained"] for r in cohorts.cohort_long(t).collect()}
    assert kept["M1"] == 1 and kept["M2"] == 0


def test_immature_cohorts_are_left_out(spark):
    t = tables(spark, customers=[dict(customer_id=1)], subscriptions=[dict(subscription_id=1, customer_id=1, start_date="2001-07-15")])
    row = rows_of(cohorts.cohort_matrix(t))[0]
    assert row["M1"] == 100.0 and row["M2"] is None
    # the fixed-day report does not censor
    assert rows_of(cohorts.cohort_milestones(t))[0]["m12_pct"] == 100.0


def test_gap_month(spark):
    t = tables(spark, transactions=[
        dict(transaction_id=1, customer_id=1, subscription_id=1, transaction_date="2000-01-10"),
        dict(transaction_id=2, customer_id=1, subscription_id=1, transaction_date="2000-03-10")])
    assert [r["revenue_month"] for r in revenue.monthly_revenue(t).collect()] == ["2000-01", "2000-03"]
    assert [r["revenue"] for r in exploration.monthly_revenue_filled(t).collect()] == [10.0, 0.0, 10.0]
    growth = [r["mom_growth_pct"] for r in revenue.mom_growth(t).collect()]
    assert growth == [None, 0.0]


@pytest.mark.parametrize("prior,recent,want", [(0, 4, 1.0), (1, 9, 5.0), (4, 2, 0.5), (None, 4, 1.0)])
def test_engagement_trend(spark, prior, recent, want):
    activity = [dict(activity_id=1, customer_id=1, activity_date="2001-08-20", sessions=recent)]
    if prior is not None:
        activity.append(dict(activity_id=2, customer_id=1, activity_date="2001-07-01", sessions=prior))
    t = tables(spark, customers=[dict(customer_id=1)], subscriptions=[dict(subscription_id=1, customer_id=1)],
               customer_activity=activity)
    assert features.features(t).first()["engagement_trend_ratio"] == want


def test_features_stop_at_cancellation(spark):
    t = tables(
        spark, customers=[dict(customer_id=1)],
        subscriptions=[dict(subscription_id=1, customer_id=1, start_date="2000-01-01", subscription_status="Cancelled",
                            end_date="2000-03-01", cancellation_date="2000-03-01")],
        customer_activity=[dict(activity_id=1, customer_id=1, activity_date="2000-03-01", sessions=2),
                           dict(activity_id=2, customer_id=1, activity_date="2000-03-02", sessions=100)],
        transactions=[dict(transaction_id=1, customer_id=1, subscription_id=1, transaction_date="2000-02-20"),
                      dict(transaction_id=2, customer_id=1, subscription_id=1, transaction_date="2000-04-01")])
    row = features.features(t).first()
    assert (row["avg_sessions"], row["total_transactions"], row["recency_days"], row["tenure_days"]) == (2.0, 1, 10, 60)


def test_recency_falls_back_to_tenure(spark):
    t = tables(spark, customers=[dict(customer_id=1)], subscriptions=[dict(subscription_id=1, customer_id=1, start_date="2001-08-01")])
    row = features.features(t).first()
    assert row["recency_days"] == row["tenure_days"] == 31


def test_declining_engagement_needs_both_windows(spark):
    subs = [dict(subscription_id=i, customer_id=i) for i in (1, 2, 3)]
    use = lambda i, c, d, s: dict(activity_id=i, customer_id=c, activity_date=d, sessions=s)
    t = tables(spark, subscriptions=subs, customer_activity=[
        use(1, 1, "2001-08-01", 5), use(2, 1, "2001-07-31", 10), use(3, 2, "2001-08-10", 1), use(4, 3, "2001-08-10", 6),
        use(5, 3, "2001-06-01", 10), use(6, 2, "2001-05-31", 10)])
    assert [r["customer_id"] for r in behaviour.declining_customers(t).collect()] == [1]


def test_yates_applies_to_two_by_two(spark):
    cells = {("a", 1): 10, ("a", 0): 20, ("b", 1): 30, ("b", 0): 40}
    rows = [(k, f) for (k, f), n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, churn int")
    got = association.chi_square(df, {"k": "K"}).first()
    # sum over cells of (|o - e| - 0.5)^2 / e with e = 12, 18, 28, 42
    assert got["statistic"] == pytest.approx(sum((2 - 0.5) ** 2 / e for e in (12, 18, 28, 42)))
    assert got["dof"] == 1.0


def test_risk_tier_is_cut_after_rounding(spark):
    df = spark.createDataFrame([(0.69996,), (0.69994,), (0.4,)], "p double")
    got = [r[0] for r in df.select(risk_tier(dec_round("p", 4))).collect()]
    assert got == ["High", "Medium", "Medium"]


def test_annual_price_switch(spark):
    df = spark.createDataFrame([("Annual", 10.0), ("Monthly", 10.0)], "billing_cycle string, monthly_price double")
    assert [r[0] for r in df.select(annualised()).collect()] == [10.0, 120.0]
    assert [r[0] for r in df.select(annualised(annual_price_is_yearly=False)).collect()] == [120.0, 120.0]


def test_safe_divide(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(safe_divide("a", "b")).collect()] == [0.0, 0.25, 0.0]


def test_view_defaults(spark):
    t = tables(spark, customers=[dict(customer_id=1, signup_date="2001-06-01")],
               transactions=[dict(transaction_id=1, customer_id=1, subscription_id=1, payment_status="Failed")])
    row = customer_view.customer_360(t).first()
    assert row["is_churned"] == 0 and row["plan_id"] is None and row["total_revenue"] == 0.0
    assert row["avg_sessions"] == 0.0 and row["avg_satisfaction"] is None and row["tenure_months"] == 3
    # the last date covers transactions that are no revenue
    assert row["last_transaction_date"] == dt.date(2000, 2, 1)


def test_mrr_follows_starts_and_ends(spark):
    t = tables(spark, as_of=dt.date(2000, 4, 30), subscriptions=[
        dict(subscription_id=1, customer_id=1, start_date="2000-01-05", monthly_price="10.00"),
        dict(subscription_id=2, customer_id=2, start_date="2000-02-05", end_date="2000-04-10", cancellation_date="2000-04-10",
             subscription_status="Cancelled", billing_cycle="Annual", monthly_price="12.00")])
    assert [r["mrr"] for r in dashboards.mrr_trend(t).collect()] == [10.0, 11.0, 11.0, 10.0]


# ---- cleaning -------------------------------------------------------------------------------------------------------


def raw(spark, **given):
    t = tables(spark, customers=[dict(customer_id=1)], subscriptions=[dict(subscription_id=1, customer_id=1)])
    return t.replace(**given)


def test_dedupe_before_repair_keeps_a_flipped_copy(spark):
    rows = [dict(transaction_id=1, customer_id=1, subscription_id=1, amount="10.00", ingest_ord=0),
            dict(transaction_id=1, customer_id=1, subscription_id=1, amount="-10.00", ingest_ord=1)]
    t = raw(spark, transactions=frame(spark, "transactions", rows, extra="ingest_ord"))
    assert cleaning.clean_transactions(t).table().count() == 2
    assert cleaning.clean_transactions(t, dedupe_after_repair=True).table().count() == 1


def test_negative_charge_without_status_is_repaired(spark):
    rows = [dict(transaction_id=i, customer_id=1, subscription_id=1, amount=f"-{i}.00", payment_status=s)
            for i, s in ((1, None), (2, "Refunded"), (3, "Success"))]
    t = raw(spark, transactions=frame(spark, "transactions", rows))
    got = {r["transaction_id"]: (float(r["amount"]), r["payment_status"]) for r in cleaning.clean_transactions(t).table().collect()}
    assert got == {1: (1.0, "Unknown"), 2: (-2.0, "Refunded"), 3: (3.0, "Success")}


def test_bad_dates_reset_after_backfill(spark):
    rows = [
        dict(subscription_id=1, customer_id=1, subscription_status="cancelled"),
        dict(subscription_id=2, customer_id=1, subscription_status="Cancelled", end_date="1999-12-01"),
        dict(subscription_id=3, customer_id=1, subscription_status="Cancelled", end_date="2000-05-01", discount_percentage=None),
    ]
    t = raw(spark, subscriptions=frame(spark, "subscriptions", rows))
    got = {r["subscription_id"]: r for r in cleaning.clean_subscriptions(t).table().collect()}
    assert got[1]["subscription_status"] == "Cancelled" and got[1]["cancellation_date"] == t.as_of
    assert got[2]["subscription_status"] == "Active" and got[2]["cancellation_date"] is None and got[2]["end_date"] is None
    assert got[3]["cancellation_date"] == dt.date(2000, 5, 1) and got[3]["discount_percentage"] == 0


def test_age_is_imputed_half_to_even(spark):
    rows = [dict(customer_id=i, age=a) for i, a in ((1, 30), (2, 31), (3, None), (4, 150))]
    t = raw(spark, customers=frame(spark, "customers", rows))
    got = {r["customer_id"]: r["age"] for r in cleaning.clean_customers(t).table().collect()}
    assert got == {1: 30, 2: 31, 3: 30, 4: 30}


def test_no_orphans_no_interaction_row(spark):
    t = raw(spark, customer_campaign_interactions=frame(
        spark, "customer_campaign_interactions", [dict(interaction_id=1, customer_id=1)]))
    assert cleaning.clean_interactions(t).audit().count() == 0


def test_rows_are_not_shuffled_to_find_the_repeated_and_unknown_ones(spark):
    from holdfast.operators.audit import first_of_repeated, rows_without, unknown_codes

    rows = spark.createDataFrame([(1, 10, 0, "a"), (1, 11, 0, "b"), (1, 10, 1, "c"), (2, 12, 0, None), (3, None, 0, "d")],
                                 "k long, id long, ingest_ord int, x string")
    first = first_of_repeated(rows, ["k"], "id")
    assert sorted(r["x"] or "" for r in first.collect()) == ["", "a", "d"]
    parents = {"k": spark.createDataFrame([(1,), (3,)], "k long")}
    known = rows_without(rows, unknown_codes(rows, parents), list(parents))
    assert sorted(r["x"] for r in known.collect()) == ["a", "b", "c", "d"]
    # the one shuffle is that of the repeated keys' rows
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2
    assert known._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
