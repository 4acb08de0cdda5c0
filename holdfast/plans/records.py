"""The nested JSON records read back with a declared schema and laid out as rows (m16, k27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from holdfast.plans.churn_model import run_summary
from holdfast.plans.kpi import headline_json
from holdfast.sources.tables import Tables

METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
TIERS = ["high_risk_customers", "medium_risk_customers", "low_risk_customers"]
COUNTS = ["total_customers", "churned_customers", "active_customers", "total_subscriptions", "total_transactions"]
FIGURES = ["overall_churn_rate_pct", "churn_monthly_pct", "churn_annual_pct", "total_revenue", "arpu", "annualized_revenue_lost_to_churn"]
SEGMENT = ["customers", "total_revenue", "churn_rate", "pct_of_customers", "pct_of_revenue"]


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


_TEXT, _NUMBER, _COUNT = T.StringType(), T.DoubleType(), T.LongType()
SUMMARY = T.StructType([
    T.StructField("best_model", _TEXT),
    T.StructField("model_comparison", T.ArrayType(T.StructType([T.StructField("model", _TEXT), *_fields(METRICS, _NUMBER)]))),
    T.StructField("total_revenue_at_risk", _NUMBER), *_fields(TIERS, _COUNT),
    T.StructField("risk_thresholds", T.StructType(_fields(["high", "medium"], _NUMBER))),
])
HEADLINE = T.StructType([
    *_fields(COUNTS, _COUNT), *_fields(FIGURES, _NUMBER), T.StructField("churn_by_plan", T.MapType(_TEXT, _NUMBER)),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("segment", _TEXT), *_fields(SEGMENT, _NUMBER)]))),
    T.StructField("model", SUMMARY),
])


def _cell(section: str, item: str | Column, value: Column | None = None, label: Column | None = None) -> Column:
    return F.struct(
        F.lit(section).alias("section"), (F.lit(item) if isinstance(item, str) else item).alias("item"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        (F.lit(None) if label is None else label).cast("string").alias("label"))


def _plain(section: str, record: Column, names: list[str]) -> Column:
    return F.array(*[_cell(section, n, record[n]) for n in names])


def _named(section: str, entries: Column, key: str, names: list[str]) -> Column:
    """A cell ``<key>.<name>`` for each entry of an array of structs and each of the names."""
    return F.flatten(F.transform(entries, lambda e: F.array(*[_cell(section, F.concat_ws(".", e[key], F.lit(n)), e[n]) for n in names])))


def _summary_cells(record: Column) -> list[Column]:
    return [
        F.array(_cell("best_model", "model", label=record["best_model"]), _cell("risk", "total_revenue_at_risk", record["total_revenue_at_risk"])),
        _plain("risk", record, TIERS), _plain("threshold", record["risk_thresholds"], ["high", "medium"]),
        _named("comparison", record["model_comparison"], "model", METRICS),
    ]


def _rows(text: DataFrame, cells: list[Column]) -> DataFrame:
    return text.select(F.inline(F.concat(*cells)))


def summary_rows(t: Tables) -> DataFrame:
    """(section, item, value, label): the run summary written as JSON and read again."""
    record = run_summary(t)
    text = record.select(F.to_json(F.struct(*record.columns)).alias("json"))
    return read_summary(text)


def read_summary(text: DataFrame, column: str = "json") -> DataFrame:
    """The rows of run summaries that stand as JSON in a column."""
    return _rows(text.select(F.from_json(column, SUMMARY, {"mode": "FAILFAST"}).alias("r")), _summary_cells(F.col("r")))


def snapshot_rows(t: Tables) -> DataFrame:
    """(section, item, value, label): the headline record written as JSON and read again."""
    return read_snapshot(headline_json(t), "snapshot")


def read_snapshot(text: DataFrame, column: str = "snapshot") -> DataFrame:
    parsed = text.select(F.from_json(column, HEADLINE, {"mode": "FAILFAST"}).alias("r"))
    r = F.col("r")
    plans = F.transform(F.map_entries(r["churn_by_plan"]), lambda e: _cell("churn_by_plan", e["key"], e["value"]))
    return _rows(parsed, [_plain("headline", r, [*COUNTS, *FIGURES]), plans, _named("segments", r["segments"], "segment", SEGMENT), *_summary_cells(r["model"])])

