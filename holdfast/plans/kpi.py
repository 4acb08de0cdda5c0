"""KPI measures with an optional filter context (k01-k27).

``kpi(t, name, by=..., where=..., start=..., end=...)`` computes a measure over
the rows a report's slicers leave: ``by`` and ``where`` name attributes of the
customer, its segment, the plan or the billing cycle, ``start``/``end`` bound
the measure's own date, and ``by`` may include ``month`` of that date. Only new customers are bound to the signup date;
subscriptions are bound to their start, or to the cancellation if that role is asked for. An attribute a fact has no
path to leaves the fact whole: it neither filters it nor splits it, so its total stands in every group.

Every fact is reduced to customer (and subscription or plan) before an attribute
is joined, and measures are sums that add up, so the reduction loses nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.functions.business import (
    CANCELLED, HIGH_RISK, MEDIUM_RISK, PRIORITY_LABELS, annualised, is_active, is_cancelled, recognised, risk_tier,
)
from holdfast.functions.scalars import dec_round, month_start, pct, ratio, safe_divide
from holdfast.operators.stable import stable
from holdfast.operators.timeline import by_month, fill_months, running
from holdfast.sources.tables import Tables

CUSTOMER_ATTRIBUTES = ("region", "acquisition_channel", "country", "gender", "referral_source", "age", "signup_date")
PLAN_ATTRIBUTES = ("plan_name", "plan_type", "max_devices", "premium_support")
BILLING = "billing_cycle"
SEGMENT = "segment"
MONTH = "month"


class Part(NamedTuple):
    """An additive ingredient: a sum, or the number of customers with any row where the condition holds."""

    base: str
    kind: str  # "sum" or "customers"
    of: Callable[[Tables], Column]


class Measure(NamedTuple):
    parts: dict[str, Part]
    value: Callable[[], Column]


def _one(_: Tables) -> Column:
    return F.lit(1)


def _sum_of(name: str) -> Callable[[Tables], Column]:
    return lambda _: F.col(name)


def _known(name: str) -> Callable[[Tables], Column]:
    return lambda _: F.when(F.col(name).isNotNull(), 1)


def _monthly_value(cycle: str) -> Callable[[Tables], Column]:
    return lambda _: F.when((F.col(BILLING) == "Annual") == F.lit(cycle == "Annual"), is_active() * F.col("monthly_price"))


def _tenure(t: Tables) -> Column:
    return F.datediff(F.coalesce("cancellation_date", F.lit(t.as_of)), "start_date")


def _when(condition: Callable[[], Column], value: Callable[[], Column]) -> Callable[[Tables], Column]:
    return lambda _: F.when(condition(), value())


_TOTAL = Part("customers", "customers", lambda _: F.lit(True))
_ACTIVE = Part("subscriptions", "customers", lambda _: is_active() == 1)
_NEW = Part("signups", "customers", lambda _: F.lit(True))
_REVENUE = Part("transactions", "sum", _sum_of("amount"))


def _mean(base: str, column: str) -> Measure:
    return Measure(
        {"s": Part(base, "sum", _sum_of(column)), "n": Part(base, "sum", _known(column))}, lambda: ratio("s", "n")
    )


def _double(name: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _count(name: str) -> Callable[[], Column]:
    return lambda: F.coalesce(name, F.lit(0)).cast("long")


MEASURES: dict[str, Measure] = {
    "total_customers": Measure({"total": _TOTAL}, _count("total")),
    "active_customers": Measure({"active": _ACTIVE}, _count("active")),
    "churned_customers": Measure({"total": _TOTAL, "active": _ACTIVE}, lambda: _count("total")() - _count("active")()),
    "new_customers": Measure({"new": _NEW}, _count("new")),
    "churn_rate": Measure(
        {"total": _TOTAL, "active": _ACTIVE}, lambda: safe_divide(_count("total")() - _count("active")(), "total")
    ),
    "retention_rate": Measure(
        {"total": _TOTAL, "active": _ACTIVE},
        lambda: 1.0 - safe_divide(_count("total")() - _count("active")(), "total"),
    ),
    "avg_tenure_days": Measure(
        {"s": Part("subscriptions", "sum", _tenure), "n": Part("subscriptions", "sum", _one)}, lambda: ratio("s", "n")
    ),
    "total_revenue": Measure({"revenue": _REVENUE}, _double("revenue")),
    "mrr": Measure(
        {"m": Part("subscriptions", "sum", _monthly_value("Monthly")), "a": Part("subscriptions", "sum", _monthly_value("Annual"))},
        lambda: dec_round(_double("m")() + _double("a")() / 12, 4),
    ),
    "arpu": Measure({"revenue": _REVENUE, "total": _TOTAL}, lambda: safe_divide("revenue", "total")),
    "revenue_lost": Measure(
        {"lost": Part("subscriptions", "sum", lambda _: F.when(F.col("subscription_status") == CANCELLED, annualised()))},
        _double("lost"),
    ),
    "clv": Measure(
        {"revenue": _REVENUE, "payers": Part("transactions", "customers", lambda _: F.lit(True))},
        lambda: ratio("revenue", "payers"),
    ),
    "avg_sessions": _mean("activity", "sessions"),
    "avg_session_duration": _mean("activity", "session_minutes"),
    "feature_usage": _mean("activity", "feature_usage_count"),
    "support_tickets": Measure({"n": Part("tickets", "sum", _one)}, _count("n")),
    "avg_satisfaction": _mean("tickets", "satisfaction_score"),
    "revenue_at_risk": Measure(
        {"r": Part("priorities", "sum", lambda _: F.col("annualized_revenue") * F.col("churn_probability"))},
        lambda: dec_round(_double("r")()),
    ),
    "high_risk_customers": Measure(
        {"n": Part("scores", "customers", lambda _: F.col("risk_level") == "High")}, _count("n")
    ),
    "high_value_at_risk": Measure(
        {"n": Part("priorities", "customers", lambda _: F.col("retention_priority") == PRIORITY_LABELS[0])}, _count("n")
    ),
    "avg_churn_probability": Measure(
        {"s": Part("scores", "sum", _sum_of("churn_probability")), "n": Part("scores", "sum", _one)},
        lambda: dec_round(ratio("s", "n"), 6),
    ),
}


def _base(t: Tables, name: str, subscription_date: str) -> tuple[DataFrame, str | None]:
    """Rows of a fact and its date column."""
    if name == "customers":
        return t.customers.select("customer_id"), None
    if name == "signups":
        return t.customers.select("customer_id", "signup_date"), "signup_date"
    if name == "subscriptions":
        return t.subscriptions, subscription_date
    if name == "transactions":
        return t.transactions.where(recognised()), "transaction_date"
    if name == "activity":
        return t.activity, "activity_date"
    if name == "tickets":
        return t.tickets, "ticket_date"
    from holdfast.plans import churn_model

    scores = churn_model.fitted(t).scores
    return (scores if name == "scores" else churn_model.worklist(scores)), None


def _link(base: str, wanted: set[str]) -> list[str]:
    """Columns that tie a fact to the wanted plan attributes; none where there is no relationship."""
    needs_plan, needs_cycle = bool(wanted & set(PLAN_ATTRIBUTES)), BILLING in wanted
    if base == "transactions" and (needs_plan or needs_cycle):
        return ["subscription_id"]
    if base == "subscriptions":
        return (["plan_id"] if needs_plan else []) + ([BILLING] if needs_cycle else [])
    if base in ("scores", "priorities"):
        return (["plan_name"] if "plan_name" in wanted else []) + ([BILLING] if needs_cycle and base == "scores" else [])
    return []


def _attach(t: Tables, df: DataFrame, link: list[str], wanted: set[str], segments: DataFrame | None) -> DataFrame:
    if link == ["subscription_id"]:
        df = df.join(t.subscriptions.select("subscription_id", "plan_id", BILLING), "subscription_id")
    plan_columns = [c for c in PLAN_ATTRIBUTES if c in wanted and c not in df.columns]
    if plan_columns and "plan_id" in df.columns:
        df = df.join(t.plans.select("plan_id", *plan_columns), "plan_id")
    person = [c for c in CUSTOMER_ATTRIBUTES if c in wanted]
    if person:
        df = df.join(t.customers.select("customer_id", *person), "customer_id")
    return df if segments is None else df.join(segments, "customer_id")


def _segments(t: Tables) -> DataFrame:
    """Segment per customer, written once for all facts of a measure."""
    from holdfast.plans.rfm import rfm

    return stable(rfm(t).select("customer_id", SEGMENT))


def _part_frame(
    t: Tables, base: str, parts: dict[str, Part], by: Sequence[str], where: Column | None, where_uses: Sequence[str],
    start: dt.date | None, end: dt.date | None, subscription_date: str, segments: DataFrame | None,
) -> DataFrame:
    """The parts of one fact, grouped by those ``by`` attributes it has a path to."""
    uses = {*by, *where_uses}
    rows, day = _base(t, base, subscription_date)
    if day and start:
        rows = rows.where(F.col(day) >= F.lit(start))
    if day and end:
        rows = rows.where(F.col(day) <= F.lit(end))
    link = _link(base, uses)
    monthly = MONTH in by and day is not None
    if monthly:
        rows = rows.where(F.col(day).isNotNull()).withColumn(MONTH, month_start(day))
    # the customer is kept only where an attribute hangs on it or customers are what is counted
    per_customer = uses & {*CUSTOMER_ATTRIBUTES, SEGMENT} or any(p.kind == "customers" for p in parts.values())
    keys = [*(["customer_id"] if per_customer else []), *link, *([MONTH] if monthly else [])]
    reduced = rows.groupBy(*keys).agg(*[
        (F.sum(p.of(t)) if p.kind == "sum" else F.max(F.when(p.of(t), 1))).alias(name) for name, p in parts.items()
    ])
    joined = _attach(t, reduced, link, uses, segments)
    if where is not None and all(c in joined.columns for c in where_uses):
        joined = joined.where(where)
    keep = [c for c in by if c in joined.columns]
    one_row_each = keys == ["customer_id"]
    return joined.groupBy(*keep).agg(*[
        (F.sum(name) if p.kind == "sum" or one_row_each
         else F.count_distinct(F.when(F.col(name) == 1, F.col("customer_id")))).alias(name)
        for name, p in parts.items()
    ])


def _values(t: Tables, attribute: str) -> Column:
    """All values of an attribute that a fact has no path to, as one array; these are dimensions of a few rows."""
    source = {BILLING: t.subscriptions, MONTH: None}.get(attribute, t.plans)
    if source is None:
        source = date_dimension(t).select(month_start("date").alias(MONTH))
    return source.agg(F.array_sort(F.collect_set(attribute))).scalar()


def _repeat(groups: DataFrame, part: DataFrame, by: Sequence[str]) -> DataFrame:
    """A part that misses some attributes, with its totals on every group that agrees on the others."""
    shared = [c for c in by if c in part.columns]
    names = [c for c in part.columns if c not in by]
    if not shared:
        one = part.select(F.struct(*names)).scalar()
        return groups.withColumns({n: one.getField(n) for n in names})
    other = part.select(*[F.col(c).alias(f"_{c}") for c in shared], *names)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in shared])
    return groups.join(other, same, "left").drop(*[f"_{c}" for c in shared])


def kpi(
    t: Tables, name: str, by: Sequence[str] = (), where: Column | None = None, where_uses: Sequence[str] = (),
    start: dt.date | None = None, end: dt.date | None = None, subscription_date: str = "start_date",
) -> DataFrame:
    """(by..., name). ``where_uses`` lists the attributes the filter refers to; ``subscription_date`` names the date of a
    subscription that months and bounds mean: ``start_date`` or ``cancellation_date``."""
    measure = MEASURES[name]
    bases = dict.fromkeys(p.base for p in measure.parts.values())
    segments = _segments(t) if SEGMENT in {*by, *where_uses} else None
    frames = [
        _part_frame(
            t, base, {n: p for n, p in measure.parts.items() if p.base == base}, by, where, where_uses, start, end,
            subscription_date, segments,
        )
        for base in bases
    ]
    full = [f for f in frames if all(c in f.columns for c in by)]
    partial = [f for f in frames if not all(c in f.columns for c in by)]
    if not full:
        widest = max(partial, key=lambda f: len(f.columns))
        for column in by:
            if column not in widest.columns:
                widest = widest.withColumn(column, F.explode(_values(t, column)))
        full, partial = [widest], [f for f in partial if not set(f.columns) <= set(widest.columns)]
    totals = full[0]
    if len(full) > 1:
        merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), full)
        names = [n for n in measure.parts if n in merged.columns]
        totals = merged.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])
    for part in partial:
        totals = _repeat(totals, part, by)
    return totals.select(*by, measure.value().alias(name))


def measure(name: str, *by: str, **context) -> Callable[[Tables], DataFrame]:
    return lambda t: kpi(t, name, by, **context)


# ---- measures over the month series ---------------------------------------------------------------------------------


def _previous(column: str) -> Column:
    # one row per month
    return F.lag(column).over(Window.orderBy("month"))


def customer_growth(t: Tables) -> DataFrame:
    """Relative change of the customer total from month to month, 0 where there is no previous month."""
    monthly = fill_months(by_month(t.customers, "signup_date", new=F.count("*")), "new")
    totals = running(monthly, "new", "total_customers")
    change = safe_divide(F.col("total_customers") - _previous("total_customers"), _previous("total_customers"))
    return totals.select("month", "total_customers", change.alias("customer_growth")).orderBy("month")


def monthly_revenue(t: Tables) -> DataFrame:
    monthly = by_month(t.transactions.where(recognised()), "transaction_date", revenue=F.sum("amount"))
    return fill_months(monthly, "revenue").select("month", F.col("revenue").cast("double").alias("monthly_revenue"))


def revenue_growth(t: Tables) -> DataFrame:
    """As monthly growth elsewhere, but 0 instead of missing for the first month."""
    revenue = monthly_revenue(t)
    change = safe_divide(F.col("monthly_revenue") - _previous("monthly_revenue"), _previous("monthly_revenue"))
    return revenue.select("month", "monthly_revenue", change.alias("revenue_growth")).orderBy("month")


# ---- thresholds, calendar, snapshot ---------------------------------------------------------------------------------

# Ranges of the two what-if thresholds, in hundredths.
HIGH_RANGE = range(50, 91, 5)
MEDIUM_RANGE = range(20, 61, 5)


def dynamic_risk_level(t: Tables, high: float = HIGH_RISK, medium: float = MEDIUM_RISK) -> DataFrame:
    """Customers per tier at chosen thresholds."""
    from holdfast.plans.churn_model import scores

    tier = risk_tier(F.col("churn_probability"), high, medium).alias("risk_level")
    return scores(t).groupBy(tier).agg(F.count("*").alias("customers"))


def risk_level_sweep(t: Tables) -> DataFrame:
    """Customers per tier for every threshold pair, empty tiers as 0.

    Scores have four decimals, so they are first counted by value (at most 10,001 rows) and only those
    counts are repeated per pair. Where the medium threshold is above the high one, the high tier comes first.
    """
    from holdfast.plans.churn_model import scores

    pairs = F.array(*[
        F.struct(F.lit(h / 100).alias("high"), F.lit(m / 100).alias("medium")) for h in HIGH_RANGE for m in MEDIUM_RANGE
    ])
    counted = scores(t).groupBy("churn_probability").agg(F.count("*").alias("n"))
    repeated = counted.select("churn_probability", "n", F.inline(pairs))
    tier = risk_tier(F.col("churn_probability"), F.col("high"), F.col("medium")).alias("risk_level")
    tiers = F.array(*[
        F.struct(F.lit(name).alias("risk_level"), F.coalesce(F.sum(F.when(F.col("risk_level") == name, F.col("n"))), F.lit(0)).alias("customers"))
        for name in ("High", "Medium", "Low")
    ])
    cells = repeated.select("high", "medium", "n", tier).groupBy("high", "medium").agg(tiers.alias("tiers"))
    return cells.select("high", "medium", F.inline("tiers"))


def date_dimension(t: Tables) -> DataFrame:
    """One row per day from the first event in the data to the observation date."""
    firsts = [
        frame.agg(F.min(day).alias("d")) for frame, day in (
            (t.customers, "signup_date"), (t.subscriptions, "start_date"), (t.transactions, "transaction_date"),
            (t.activity, "activity_date"), (t.tickets, "ticket_date"),
        )
    ]
    first = reduce(DataFrame.unionByName, firsts).agg(F.min("d").alias("d"))
    days = first.select(F.explode(F.sequence("d", F.lit(t.as_of))).alias("date"))
    return days.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"), F.date_format("date", "yyyy-MM").alias("year_month"),
    )


def headline_snapshot(t: Tables) -> DataFrame:
    """One row of headline counts and rates at customer grain."""
    from holdfast.plans.exploration import customer_status

    people = customer_status(t).groupBy(BILLING).agg(F.count("*").alias("n"), F.sum(is_cancelled()).alias("gone"))
    # at most three rows: two billing cycles and none
    gone = F.sum("gone")
    in_cycle = lambda c, x: F.sum(F.when(F.col(BILLING) == c, F.col(x)))
    subs = t.subscriptions.agg(F.struct(
        F.count("*").alias("n"), F.sum(F.when(F.col("subscription_status") == CANCELLED, annualised())).alias("lost")
    )).scalar()
    txns = t.transactions.agg(F.struct(
        F.count("*").alias("n"), F.sum(F.when(recognised(), F.col("amount"))).alias("revenue")
    )).scalar()
    revenue = txns.getField("revenue")
    return people.agg(
        F.sum("n").alias("total_customers"), gone.alias("churned_customers"),
        pct(gone, F.sum("n")).alias("overall_churn_rate_pct"),
        pct(in_cycle("Monthly", "gone"), in_cycle("Monthly", "n")).alias("churn_monthly_pct"),
        pct(in_cycle("Annual", "gone"), in_cycle("Annual", "n")).alias("churn_annual_pct"),
    ).select(
        "*", (F.col("total_customers") - F.col("churned_customers")).alias("active_customers"),
        subs.getField("n").alias("total_subscriptions"), txns.getField("n").alias("total_transactions"),
        revenue.cast("double").alias("total_revenue"),
        dec_round(ratio(revenue, "total_customers")).alias("arpu"),
        subs.getField("lost").cast("double").alias("annualized_revenue_lost_to_churn"),
    )


def headline_json(t: Tables) -> DataFrame:
    """The snapshot with plan churn, segments and the model summary nested, as one JSON record."""
    from holdfast.plans.churn_model import run_summary
    from holdfast.plans.exploration import churn_by_plan
    from holdfast.plans.rfm import segment_summary

    # one row per plan, per segment, and one
    plans = churn_by_plan(t).agg(F.map_from_entries(F.collect_list(F.struct("plan_name", "churn_rate_pct")))).scalar()
    segments = segment_summary(t)
    listed = segments.agg(F.sort_array(F.collect_list(F.struct(
        "total_revenue", "segment", "customers", "churn_rate", "pct_of_customers", "pct_of_revenue"
    )), asc=False)).scalar()
    summary = run_summary(t)
    model = summary.select(F.struct(*summary.columns)).scalar()
    record = headline_snapshot(t)
    nested = F.struct(*record.columns, plans.alias("churn_by_plan"), listed.alias("segments"), model.alias("model"))
    return record.select(F.to_json(nested).alias("snapshot"))
