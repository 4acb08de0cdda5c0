"""Association of churn with its candidate drivers (s00-s04). Association is not causation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.functions.business import is_cancelled
from holdfast.functions.pvalues import p_value
from holdfast.functions.scalars import dec_round
from holdfast.operators.customer_grain import engagement_by_customer, latest_subscription, support_by_customer
from holdfast.sources.tables import Tables

# Tested columns, their labels and the report's wording.
CONTINUOUS = {
    "tenure_days": "Tenure (days)",
    "monthly_price": "Monthly price",
    "avg_sessions": "Average sessions",
    "n_tickets": "Support ticket count",
    "avg_satisfaction": "Average satisfaction score",
}
CATEGORICAL = {"billing_cycle": "Billing cycle", "plan_id": "Plan", "acquisition_channel": "Acquisition channel"}
T_TEST, CHI_TEST, PB_TEST = "Independent t-test", "Chi-square test of independence", "Point-biserial correlation"
PB_LABEL = "Avg sessions vs churn"
ALPHA = 0.05
TINY_P = 0.0001


def stat_base(t: Tables) -> DataFrame:
    """One row per customer with a subscription. An active subscription's tenure runs to the observation date."""
    latest = latest_subscription(
        t.subscriptions, "start_date", "cancellation_date", "subscription_status", "monthly_price", "billing_cycle", "plan_id"
    )
    usage = engagement_by_customer(t.activity).select("customer_id", "avg_sessions")
    support = support_by_customer(t.tickets).select("customer_id", "n_tickets", "avg_satisfaction")
    people = t.customers.select("customer_id", "age", "acquisition_channel")
    return (
        latest.join(people, "customer_id", "left").join(usage, "customer_id", "left").join(support, "customer_id", "left")
        .select(
            "customer_id", is_cancelled().alias("churn"),
            F.datediff(F.coalesce("cancellation_date", F.lit(t.as_of)), "start_date").alias("tenure_days"),
            F.col("monthly_price").cast("double").alias("monthly_price"), "billing_cycle", "plan_id",
            "acquisition_channel", "age", "avg_sessions", "avg_satisfaction",
            F.coalesce("n_tickets", F.lit(0)).alias("n_tickets"),
        )
    )


def welch_t(df: DataFrame, columns: Mapping[str, str] = CONTINUOUS, flag: str = "churn") -> DataFrame:
    """Unequal-variance t per column, flagged against the rest, from one grouped pass over all columns."""
    cells = [F.struct(F.lit(label).alias("variable"), F.col(c).cast("double").alias("x")) for c, label in columns.items()]
    moments = (
        df.select(F.col(flag).alias("flag"), F.inline(F.array(*cells))).where(F.col("x").isNotNull())
        .groupBy("variable").agg(*[
            agg(F.when(F.col("flag") == side, F.col("x"))).alias(f"{name}{side}")
            for side in (1, 0) for name, agg in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ])
    )
    a, b = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    return moments.select(
        "variable", F.col("mean1").alias("churned_mean"), F.col("mean0").alias("retained_mean"),
        ((F.col("mean1") - F.col("mean0")) / F.sqrt(a + b)).alias("statistic"),
        ((a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("dof"),
    )


def chi_square(df: DataFrame, columns: Mapping[str, str] = CATEGORICAL, flag: str = "churn") -> DataFrame:
    """Independence of each column and the flag; continuity correction when there is one degree of freedom."""
    cells = [
        F.struct(F.lit(label).alias("variable"), F.col(c).cast("string").alias("category")) for c, label in columns.items()
    ]
    table = (
        df.select(F.col(flag).alias("flag"), F.inline(F.array(*cells))).where(F.col("category").isNotNull())
        .groupBy("variable", "category")
        .agg(F.count_if(F.col("flag") == 1).alias("o1"), F.count_if(F.col("flag") == 0).alias("o0"))
    )
    # from here on one row per category
    per_variable = Window.partitionBy("variable")
    row = F.col("o1") + F.col("o0")
    sums = table.withColumns({
        "c1": F.sum("o1").over(per_variable), "c0": F.sum("o0").over(per_variable),
        "dof": F.count("*").over(per_variable) - 1, "row": row,
    }).withColumn("total", F.col("c1") + F.col("c0"))

    def cell(observed: str, column: str) -> Column:
        expected = F.col("row") * F.col(column) / F.col("total")
        gap = F.abs(F.col(observed) - expected)
        corrected = F.when(F.col("dof") == 1, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
        return corrected * corrected / expected

    return sums.groupBy("variable").agg(
        F.sum(cell("o1", "c1") + cell("o0", "c0")).alias("statistic"), F.max("dof").cast("double").alias("dof")
    )


def point_biserial(df: DataFrame, column: str = "avg_sessions", flag: str = "churn") -> DataFrame:
    """Correlation of the flag with a column, missing values as 0, and its t statistic."""
    r = df.agg(F.corr(flag, F.coalesce(F.col(column), F.lit(0.0))).alias("statistic"), F.count("*").alias("n"))
    return r.withColumn("dof", (F.col("n") - 2).cast("double")).withColumn(
        "t", F.col("statistic") * F.sqrt(F.col("dof") / (1 - F.col("statistic") * F.col("statistic")))
    )


def _shown(p):
    return F.when(p < TINY_P, F.format_string("%.2e", p)).otherwise(dec_round(p, 5).cast("string"))


def welch_report(t: Tables) -> DataFrame:
    return welch_t(stat_base(t)).select(
        "variable", dec_round("churned_mean").alias("churned_mean"), dec_round("retained_mean").alias("retained_mean"),
        dec_round("statistic", 3).alias("statistic"), dec_round("dof", 3).alias("dof"),
    )


def chi_square_report(t: Tables) -> DataFrame:
    return chi_square(stat_base(t)).select("variable", dec_round("statistic", 3).alias("statistic"), "dof")


def point_biserial_report(t: Tables) -> DataFrame:
    return point_biserial(stat_base(t)).select(dec_round("statistic", 3).alias("statistic"), "n")


def association_report(t: Tables) -> DataFrame:
    """All tests with p-values: nine rows."""
    base = stat_base(t)
    none = F.lit(None).cast("double")
    welch = welch_t(base).select(
        F.lit(T_TEST).alias("test"), "variable", "churned_mean", "retained_mean", "statistic",
        F.lit("t").alias("kind"), F.col("statistic").alias("tail_at"), "dof",
    )
    chi = chi_square(base).select(
        F.lit(CHI_TEST).alias("test"), "variable", none.alias("churned_mean"), none.alias("retained_mean"), "statistic",
        F.lit("chi2").alias("kind"), F.col("statistic").alias("tail_at"), "dof",
    )
    biserial = point_biserial(base).select(
        F.lit(PB_TEST).alias("test"), F.lit(PB_LABEL).alias("variable"), none.alias("churned_mean"),
        none.alias("retained_mean"), "statistic", F.lit("t").alias("kind"), F.col("t").alias("tail_at"), "dof",
    )
    tests = welch.unionByName(chi).unionByName(biserial).withColumn("p", p_value("kind", "tail_at", "dof"))
    return tests.select(
        "test", "variable", dec_round("churned_mean").alias("churned_mean"), dec_round("retained_mean").alias("retained_mean"),
        dec_round("statistic", 3).alias("statistic"), _shown(F.col("p")).alias("p_value"),
        (F.col("p") < ALPHA).alias("significant_at_0_05"),
    )
