"""Cleaning of the eight raw tables, each with its audit (cl01-cl26, clean_*).

``clean_<table>`` returns the repaired table and the audit of what was done. Both
derive from one flagged frame in which every row carries what is wrong with it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.business import ACTIVE, CANCELLED, CHARGE, is_cancelled
from holdfast.functions.scalars import is_all_lower, is_all_upper, pct, title_case
from holdfast.operators.audit import (
    COPIES, Check, audit, first_of_repeated, first_order, keep_first, known_rows, mark_known, rows_without, unknown_codes,
)
from holdfast.operators.quantiles import exact_median
from holdfast.sources.tables import Tables

# Bounds, fill labels and the key of a repeated charge.
MIN_AGE, MAX_AGE = 13, 100
UNKNOWN = "Unknown"
NO_REFERRAL = "Not Captured"
UNKNOWN_PAYMENT = "Unknown"
TXN_KEY = ["customer_id", "subscription_id", "transaction_date", "transaction_type", "amount"]


class Cleaned(NamedTuple):
    """Both are built on demand: the audit needs none of the imputation jobs."""

    table: Callable[[], DataFrame]
    audit: Callable[[], DataFrame]


def _n(flag) -> Column:
    return F.count_if(flag)


def _rows() -> Column:
    return F.count("*")


def _order(df: DataFrame, key: str) -> list[str]:
    return [c for c in ("ingest_ord", key) if c in df.columns]


def clean_customers(t: Tables) -> Cleaned:
    raw = t.customers
    c = F.col
    bad_age = (c("age") < MIN_AGE) | (c("age") > MAX_AGE)
    flagged = keep_first(raw, ["customer_id"], _order(raw, "customer_id")).withColumns({
        "_upper_country": is_all_upper("country"),
        "_lower_gender": is_all_lower("gender"),
        "_bad_age": bad_age,
        "_no_gender": c("gender").isNull(),
        "_no_country": c("country").isNull(),
        "_no_referral": c("referral_source").isNull(),
        "age": F.when(~bad_age, c("age")),
    })

    def table() -> DataFrame:
        # ages are at most MAX_AGE distinct values, so the built-in median holds a bounded map per region
        medians = flagged.groupBy("region").agg(F.median("age").alias("_region_age"))
        # one row per region: adaptive execution broadcasts it by its measured bytes
        return flagged.join(medians, "region", "left").select(
            "customer_id", "signup_date",
            F.coalesce(title_case("gender"), F.lit(UNKNOWN)).alias("gender"),
            F.bround(F.coalesce(c("age").cast("double"), c("_region_age"))).cast("int").alias("age"),
            F.coalesce(title_case("country"), F.lit(UNKNOWN)).alias("country"),
            F.coalesce("region", F.lit(UNKNOWN)).alias("region"),
            "acquisition_channel",
            F.coalesce("referral_source", F.lit(NO_REFERRAL)).alias("referral_source"),
        )

    flags = ["_upper_country", "_lower_gender", "_bad_age", "_no_age", "_no_gender", "_no_country", "_no_referral"]

    def flagged_only() -> DataFrame:
        """The first rows' flags alone, as one whole number per customer, which Spark reduces by hash."""
        if "ingest_ord" not in raw.columns:
            # nothing but the remaining columns tells which row is the first
            return flagged.withColumn("_no_age", c("age").isNull())
        rows = raw.withColumns({
            "_upper_country": is_all_upper("country"), "_lower_gender": is_all_lower("gender"), "_bad_age": bad_age,
            "_no_age": c("age").isNull() | bad_age, "_no_gender": c("gender").isNull(), "_no_country": c("country").isNull(),
            "_no_referral": c("referral_source").isNull(),
        })
        bits = reduce(Column.__add__, [F.coalesce(c(f), F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(flags)])
        first = rows.select("customer_id", bits.alias("_bits"), first_order(raw, "customer_id").alias("_place")).groupBy("customer_id").agg(
            F.min_by("_bits", "_place").alias("_bits"), F.count("*").alias(COPIES))
        return first.withColumns({f: c("_bits").bitwiseAND(1 << i) > 0 for i, f in enumerate(flags)})

    checks = [
        Check("duplicate_customers", F.sum(c(COPIES) - 1), F.sum(COPIES), "first row kept", "customer_id is the natural key"),
        Check("country_case", _n(c("_upper_country")), _rows(), "title case", "sources differ in letter case"),
        Check("gender_case", _n(c("_lower_gender")), _rows(), "title case", "manual entry"),
        Check("invalid_age", _n(c("_bad_age")), _rows(), "set missing, then imputed", "outside the human range"),
        Check("missing_age", _n(c("_no_age")), _rows(), "median of the region", "needed for age bands"),
        Check("missing_gender", _n(c("_no_gender")), _rows(), "label Unknown", "no value is invented"),
        Check("missing_country", _n(c("_no_country")), _rows(), "label Unknown", "keeps the revenue history"),
        Check("missing_referral", _n(c("_no_referral")), _rows(), "label Not Captured", "optional attribute"),
    ]
    return Cleaned(table, lambda: audit(flagged_only(), checks))


def clean_subscriptions(t: Tables) -> Cleaned:
    c = F.col
    flagged = (
        t.subscriptions
        .withColumn("_lower_status", is_all_lower("subscription_status"))
        .withColumn("subscription_status", title_case("subscription_status"))
        .withColumn("_no_date", (c("subscription_status") == CANCELLED) & c("cancellation_date").isNull())
        .withColumn("_no_discount", c("discount_percentage").isNull())
        .withColumn("_bad_dates", F.coalesce(c("end_date") < c("start_date"), F.lit(False)))
    )
    cancel_date = F.when(c("_no_date"), F.coalesce("end_date", F.lit(t.as_of))).otherwise(c("cancellation_date"))
    clean = flagged.withColumns({
        "cancellation_date": F.when(~c("_bad_dates"), cancel_date),
        "end_date": F.when(~c("_bad_dates"), c("end_date")),
        "subscription_status": F.when(c("_bad_dates"), ACTIVE).otherwise(c("subscription_status")),
        "discount_percentage": F.coalesce("discount_percentage", F.lit(0)),
    }).select(*t.subscriptions.columns)
    checks = [
        Check("status_case", _n(c("_lower_status")), _rows(), "title case", "sources differ in letter case"),
        Check("cancelled_without_date", _n(c("_no_date")), _rows(), "end date, else the cutoff", "churn needs a date"),
        Check("missing_discount", _n(c("_no_discount")), _rows(), "0", "no record means no discount"),
        Check("end_before_start", _n(c("_bad_dates")), _rows(), "dates cleared, status Active", "impossible order"),
    ]
    return Cleaned(lambda: clean, lambda: audit(flagged, checks))


def clean_transactions(t: Tables, dedupe_after_repair: bool = False) -> Cleaned:
    """Duplicates go before the sign repair, so a copy whose sign was flipped survives.

    ``dedupe_after_repair`` turns the order round.
    """
    c = F.col
    raw = t.transactions

    def negative(status: Column) -> Column:
        return (c("transaction_type") == CHARGE) & (c("amount") < 0) & ~status.eqNullSafe("Refunded")

    def repair(df: DataFrame) -> DataFrame:
        return df.withColumn("amount", F.when(negative(c("payment_status")), F.abs("amount")).otherwise(c("amount")))

    def table() -> DataFrame:
        rows = repair(raw) if dedupe_after_repair else raw
        first = first_of_repeated(rows, TXN_KEY, "transaction_id")
        if not dedupe_after_repair:
            first = repair(first)
        parents = {"subscription_id": t.subscriptions, "customer_id": t.customers}
        known = rows_without(first, unknown_codes(raw, parents), list(parents))
        return known.withColumn("payment_status", F.coalesce("payment_status", F.lit(UNKNOWN_PAYMENT))).select(
            *[col for col in t.transactions.columns if col != "ingest_ord"])

    def audit_rows() -> DataFrame:
        counts = mark_known(_transaction_counts(t, dedupe_after_repair), "customer_id", t.customers, "_cust_ok")
        return audit(counts, _transaction_checks())

    return Cleaned(table, audit_rows)


def _transaction_counts(t: Tables, dedupe_after_repair: bool = False) -> DataFrame:
    """What the audit counts of the deduplicated transactions, per customer and whether the subscription is known."""
    c = F.col
    raw = t.transactions
    # only key columns and a code of the first row's status are moved: 0 missing, 1 refunded, 2 any other
    status = F.when(c("payment_status").isNull(), 0).when(c("payment_status") == "Refunded", 1).otherwise(2)
    rows = raw.select(*TXN_KEY, status.alias("status"), first_order(raw, "transaction_id").alias("place"))
    if dedupe_after_repair:
        fixed = (c("transaction_type") == CHARGE) & (c("amount") < 0) & (c("status") != 1)
        rows = rows.withColumn("negative", fixed.cast("int")).withColumn("amount", F.when(fixed, F.abs("amount")).otherwise(c("amount")))
    else:
        rows = rows.withColumn("negative", F.lit(0))
    first = rows.groupBy(*TXN_KEY).agg(
        F.count("*").alias(COPIES), F.min_by("status", "place").alias("status"), F.min_by("negative", "place").alias("negative"))
    if not dedupe_after_repair:
        found = (c("transaction_type") == CHARGE) & (c("amount") < 0) & (c("status") != 1)
        first = first.withColumn("negative", found.cast("int"))
    # one row per subscription and customer meets the subscriptions
    counts = first.groupBy("subscription_id", "customer_id").agg(
        F.sum(COPIES).alias("txn_copies"), F.count("*").alias("txn_rows"), F.sum("negative").alias("txn_negative"),
        F.count_if(c("status") == 0).alias("txn_no_status"))
    flagged = mark_known(counts, "subscription_id", t.subscriptions, "_sub_ok")
    figures = ["txn_copies", "txn_rows", "txn_negative", "txn_no_status"]
    return flagged.groupBy("customer_id", "_sub_ok").agg(*[F.sum(x).alias(x) for x in figures])


def _transaction_checks() -> list[Check]:
    c = F.col
    of = lambda condition, n: F.sum(F.when(condition, c(n)))
    known = of(c("_sub_ok"), "txn_rows")
    return [
        Check("duplicate_transactions", F.sum(c("txn_copies") - c("txn_rows")), F.sum("txn_copies"), "first row kept", "repeated billing event"),
        Check("orphan_subscription", of(~c("_sub_ok"), "txn_rows"), F.sum("txn_copies"), "excluded", "no subscription to attribute to"),
        Check("negative_charge", of(c("_sub_ok"), "txn_negative"), known, "absolute value", "sign error at the source"),
        Check("missing_payment_status", of(c("_sub_ok"), "txn_no_status"), known, "label Unknown", "row kept, status flagged"),
        Check("orphan_customer", of(c("_sub_ok") & ~c("_cust_ok"), "txn_rows"), known, "excluded", "no customer to attribute to"),
    ]


def _keyed_counts(rows: DataFrame, prefix: str, **missing: str) -> DataFrame:
    """Rows and missing values per customer; a hot customer is one row."""
    return rows.groupBy("customer_id").agg(
        F.count("*").alias(f"{prefix}_rows"),
        *[F.count_if(F.col(column).isNull()).alias(f"{prefix}_{name}") for name, column in missing.items()])


def _activity_counts(t: Tables) -> DataFrame:
    return _keyed_counts(t.activity, "act", no_minutes="session_minutes", no_features="feature_usage_count")


def _activity_checks() -> list[Check]:
    return [
        Check("missing_minutes", F.sum("act_no_minutes"), F.sum("act_rows"), "median", "tracking gaps"),
        Check("missing_features", F.sum("act_no_features"), F.sum("act_rows"), "0", "no event means no usage"),
        Check("orphan_activity", F.sum(F.when(~F.col("_cust_ok"), F.col("act_rows"))), F.sum("act_rows"), "excluded", "no customer to attribute to"),
    ]


def _interaction_counts(t: Tables) -> DataFrame:
    return _keyed_counts(t.interactions, "int")


def _interaction_checks() -> list[Check]:
    return [Check("orphan_interactions", F.sum(F.when(~F.col("_cust_ok"), F.col("int_rows"))), F.sum("int_rows"), "excluded", "no customer to attribute to")]


def clean_activity(t: Tables) -> Cleaned:
    c = F.col

    def table() -> DataFrame:
        # the median includes the rows of unknown customers
        minutes = F.coalesce(c("session_minutes").cast("double"), exact_median(t.activity, "session_minutes"))
        return known_rows(t.activity, "customer_id", t.customers).withColumns({
            "session_minutes": minutes,
            "feature_usage_count": F.coalesce("feature_usage_count", F.lit(0)),
        }).select(*t.activity.columns)

    return Cleaned(table, lambda: audit(mark_known(_activity_counts(t), "customer_id", t.customers, "_cust_ok"), _activity_checks()))


def clean_tickets(t: Tables) -> Cleaned:
    c = F.col

    def table() -> DataFrame:
        # scores are 1 to 5, so the built-in median holds a bounded map
        score = t.tickets.agg(F.median("satisfaction_score")).scalar()
        hours = exact_median(t.tickets, "resolution_time_hours")
        return t.tickets.withColumns({
            "issue_type": title_case("issue_type"),
            "satisfaction_score": F.coalesce(c("satisfaction_score").cast("double"), score),
            "resolution_time_hours": F.coalesce(c("resolution_time_hours").cast("double"), hours),
        })

    checks = [
        Check("issue_case", _n(is_all_lower("issue_type")), _rows(), "title case", "agents type it differently"),
        Check("missing_satisfaction", _n(c("satisfaction_score").isNull()), _rows(), "median", "survey not answered"),
        Check("missing_resolution", _n(c("resolution_time_hours").isNull()), _rows(), "median", "ticket still open"),
    ]
    return Cleaned(table, lambda: audit(t.tickets, checks))


def clean_interactions(t: Tables) -> Cleaned:
    """The audit has a row only if something was excluded."""
    return Cleaned(
        lambda: known_rows(t.interactions, "customer_id", t.customers).select(*t.interactions.columns),
        lambda: _only_found(audit(mark_known(_interaction_counts(t), "customer_id", t.customers, "_cust_ok"), _interaction_checks())))


def _only_found(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("issue") != "orphan_interactions") | (F.col("affected") > 0))


CLEANERS: dict[str, Callable[[Tables], Cleaned]] = {
    "customers": clean_customers,
    "subscriptions": clean_subscriptions,
    "transactions": clean_transactions,
    "customer_activity": clean_activity,
    "support_tickets": clean_tickets,
    "customer_campaign_interactions": clean_interactions,
}

# audit issues in report order, with the table they belong to
ISSUES: dict[str, tuple[str, ...]] = {
    "customers": (
        "duplicate_customers", "country_case", "gender_case", "invalid_age", "missing_age", "missing_gender",
        "missing_country", "missing_referral",
    ),
    "subscriptions": ("status_case", "cancelled_without_date", "missing_discount", "end_before_start"),
    "transactions": (
        "duplicate_transactions", "orphan_subscription", "negative_charge", "missing_payment_status", "orphan_customer",
    ),
    "customer_activity": ("missing_minutes", "missing_features", "orphan_activity"),
    "support_tickets": ("issue_case", "missing_satisfaction", "missing_resolution"),
    "customer_campaign_interactions": ("orphan_interactions",),
}


def clean_all(t: Tables) -> Tables:
    """The eight tables after cleaning; plans and campaigns pass through."""
    frames = {name: (lambda clean=clean: clean(t).table()) for name, clean in CLEANERS.items()}
    frames["plans"] = lambda: t.plans
    frames["marketing_campaigns"] = lambda: t.campaigns
    return Tables(frames, t.as_of)


def cleaned(table: str) -> Callable[[Tables], DataFrame]:
    return lambda t: CLEANERS[table](t).table()


def audit_of(table: str, *issues: str) -> Callable[[Tables], DataFrame]:
    """Audit rows of one table, restricted to the named issues."""
    figures = ["issue", "affected", "total", "pct"]
    return lambda t: CLEANERS[table](t).audit().where(F.col("issue").isin(*issues)).select(*figures)


def quality_report(t: Tables) -> DataFrame:
    """All audit rows of all tables. The tables that refer to customers are reduced to counts per customer, which meet the
    customers together: each table is read once, customers and subscriptions once more as parents."""
    alone = [CLEANERS[name](t).audit() for name in ("customers", "subscriptions", "support_tickets")]
    # columns of one table are empty in the rows of the others, so sums pass them over
    counts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_transaction_counts(t), _activity_counts(t), _interaction_counts(t)])
    together = audit(
        mark_known(counts, "customer_id", t.customers, "_cust_ok"), [*_transaction_checks(), *_activity_checks(), *_interaction_checks()])
    return reduce(DataFrame.unionByName, [*alone, _only_found(together)])


def quality_totals(t: Tables) -> DataFrame:
    """Number of checks and of touched records; a record may be touched more than once."""
    return quality_report(t).agg(
        F.count("*").alias("checks"), F.sum("affected").alias("records_affected")
    )


def row_deltas(t: Tables) -> DataFrame:
    """Rows before and after cleaning."""
    def one(name: str) -> DataFrame:
        before = t[name].agg(F.count("*").alias("n")).scalar()
        return CLEANERS[name](t).table().agg(F.count("*").alias("processed_rows")).select(
            F.lit(name).alias("table_name"), before.alias("raw_rows"), "processed_rows",
            (before - F.col("processed_rows")).alias("removed"),
        )

    names = [n for n in CLEANERS if n != "customer_campaign_interactions"]
    return reduce(DataFrame.unionByName, [one(n) for n in names])


def raw_defect_profile(t: Tables) -> DataFrame:
    c = F.col
    per_id = t.customers.groupBy("customer_id").agg(
        F.count("*").alias("rows"),
        F.count_if(c("age").isNull()).alias("no_age"),
        F.count_if((c("age") < 0) | (c("age") > MAX_AGE)).alias("odd_age"),
        F.count_if(is_all_upper("country")).alias("upper"),
    )
    churn = t.subscriptions.agg(
        pct(F.count_if(F.lower("subscription_status") == CANCELLED.lower()), F.count("*"))
    ).scalar()
    return per_id.agg(
        F.sum(c("rows") - 1).alias("duplicate_customer_ids"), F.sum("no_age").alias("missing_ages"),
        F.sum("odd_age").alias("ages_out_of_range"), F.sum("upper").alias("uppercase_countries"),
    ).withColumn("raw_churn_rate_pct", churn)


def raw_status_counts(t: Tables) -> DataFrame:
    return t.subscriptions.groupBy("subscription_status").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


def post_clean_checks(t: Tables) -> DataFrame:
    """What must hold after cleaning: three zeros and the list of remaining statuses."""
    c = F.col
    done = clean_all(t)
    people = done.customers.groupBy("customer_id").agg(
        F.count("*").alias("rows"), F.count_if(~c("age").between(MIN_AGE, MAX_AGE)).alias("odd_age")
    )
    subs = done.subscriptions.groupBy("subscription_status").agg(
        F.sum(F.when(c("cancellation_date").isNull(), is_cancelled()).otherwise(0)).alias("no_date")
    )
    # one row per status
    summary = subs.agg(
        F.struct(
            F.sum("no_date").alias("no_date"),
            F.array_join(F.array_sort(F.collect_list("subscription_status")), ",").alias("statuses"),
        )
    ).scalar()
    return people.agg(
        F.sum(c("rows") - 1).alias("duplicate_customer_ids"), F.sum("odd_age").alias("ages_out_of_range")
    ).select(
        "*", summary.getField("no_date").alias("cancelled_without_date"),
        summary.getField("statuses").alias("distinct_statuses"),
    )
