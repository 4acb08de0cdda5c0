"""Subscription tables mapped from the TPC-H-like test tables, clean and with deterministic defects.

Every order is a subscription, every line item a transaction and every event an
activity record or a ticket: no row of the source is left out. The mapping is
row-local apart from the joins that fetch parent columns, so it adds no shuffle
beyond those.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from holdfast.sources.tables import Tables

AS_OF = dt.date(2001, 9, 1)

# Fixed values of the test mapping.
PLAN_ROWS = [
    (1, "Basic", "Individual", "9.99", 1, 0),
    (2, "Standard", "Individual", "15.99", 2, 0),
    (3, "Premium", "Family", "24.99", 5, 1),
    (4, "Enterprise", "Team", "49.99", 20, 1),
]

_SOURCE_SCHEMAS = {
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string, "
    "l_linestatus string",
    "events": "event_id long, user_id long, event_type string, value double",
    "supplier": "s_suppkey long, s_acctbal double",
}


def _cases(key: Column, values: list, otherwise) -> Column:
    """``values[i]`` where key = i, else ``otherwise``."""
    col = F.when(key == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        col = col.when(key == i, value)
    return col.otherwise(otherwise)


def _subscriber(custkey: Column) -> Column:
    """Billing customer of an order: one customer in seven hands its orders to its neighbour and never subscribes."""
    return F.when(custkey % 7 == 3, custkey - 1).otherwise(custkey)


class _Mapping:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of = F.lit(AS_OF)

    def src(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SOURCE_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        first_order = (
            self.src("orders").groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.min("o_orderdate").cast("date").alias("first_order"))
        )
        return (
            self.src("customer")
            .join(self.src("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(self.src("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .join(first_order, "c_custkey", "left")
            .select(
                key.alias("customer_id"),
                F.coalesce("first_order", F.lit(dt.date(1995, 1, 1))).alias("signup_date"),
                F.when(key % 25 == 0, "Non-Binary").when(key % 2 == 0, "Male").otherwise("Female").alias("gender"),
                (18 + (key * 7) % 60).cast("int").alias("age"),
                F.concat(F.lit("Nation "), F.substring("n_name", 8, 100)).alias("country"),
                F.col("r_name").alias("region"),
                F.col("c_mktsegment").alias("acquisition_channel"),
                _cases(key % 4, ["Colleague", "Online Ad", "App Store"], "Other").alias("referral_source"),
            )
        )

    def plans(self) -> DataFrame:
        # an inline table has exact size statistics, so joins to it are broadcast without a hint
        rows = ", ".join(f"({i}, '{n}', '{k}', CAST({p} AS DECIMAL(8,2)), {d}, {s})" for i, n, k, p, d, s in PLAN_ROWS)
        names = "plan_id, plan_name, plan_type, monthly_price, max_devices, premium_support"
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS plan_rows({names})")

    def subscriptions(self) -> DataFrame:
        key = F.col("o_orderkey")
        start = F.col("o_orderdate").cast("date")
        cancelled = F.col("o_orderstatus") == "F"
        ended = F.when(cancelled, F.least(F.date_add(start, (20 + (key * 13) % 700).cast("int")), self.as_of))
        plan = (1 + key % 4).cast("int")
        list_price = _cases(plan - 1, [F.lit(r[3]).cast("decimal(8,2)") for r in PLAN_ROWS], None)
        discount = F.coalesce(_cases(key % 7 - 3, [10, 15, 20, 30], None), F.lit(0))
        return self.src("orders").select(
            key.alias("subscription_id"),
            _subscriber(F.col("o_custkey")).alias("customer_id"),
            plan.alias("plan_id"),
            start.alias("start_date"),
            ended.alias("end_date"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "Monthly").otherwise("Annual")
            .alias("billing_cycle"),
            F.round(list_price * (100 - discount) / 100, 2).cast("decimal(8,2)").alias("monthly_price"),
            discount.alias("discount_percentage"),
            F.when(cancelled, "Cancelled").otherwise("Active").alias("subscription_status"),
            ended.alias("cancellation_date"),
            F.when(cancelled, _cases(key % 3, ["Too expensive", "Not using enough"], "Missing features"))
            .alias("cancellation_reason"),
        )

    def transactions(self) -> DataFrame:
        c = F.col
        refunded = (c("l_returnflag") == "R") & (c("l_linestatus") == "F")
        price = c("l_extendedprice")
        return (
            self.src("lineitem")
            .join(self.src("orders"), c("l_orderkey") == c("o_orderkey"))
            .select(
                ((c("l_orderkey") * 8 + c("l_linenumber")) * 1000003
                 + F.round(price * 100).cast("long") % 1000003).alias("transaction_id"),
                _subscriber(c("o_custkey")).alias("customer_id"),
                c("l_orderkey").alias("subscription_id"),
                F.least(F.date_add(c("o_orderdate").cast("date"), 30 * (c("l_linenumber") - 1)), self.as_of)
                .alias("transaction_date"),
                F.when((c("l_returnflag") == "A") & (c("l_linestatus") == "O"), "Add-on Purchase")
                .otherwise("Subscription Charge").alias("transaction_type"),
                F.when(refunded, -price).otherwise(price).cast("decimal(18,2)").alias("amount"),
                F.round((price * c("l_discount")).cast("decimal(28,8)"), 2).cast("decimal(18,2)").alias("discount_amount"),
                F.when(refunded, "Refunded").when(c("l_returnflag") == "R", "Failed").otherwise("Success")
                .alias("payment_status"),
            )
        )

    def _events(self) -> DataFrame:
        return self.src("events").withColumn("customer_id", F.col("user_id") * 10 + F.col("event_id") % 10)

    def customer_activity(self) -> DataFrame:
        key, value = F.col("event_id"), F.col("value")
        per = lambda x: F.floor(x).cast("int")
        return self._events().where(F.col("event_type") != "error").select(
            key.alias("activity_id"), "customer_id",
            F.date_sub(self.as_of, ((key * 7) % 120).cast("int")).alias("activity_date"),
            (1 + per(value / 10)).alias("sessions"),
            per(value * 3).alias("session_minutes"),
            per(value / 12).alias("content_consumed"),
            per(value / 25).alias("feature_usage_count"),
        )

    def support_tickets(self) -> DataFrame:
        key, user = F.col("event_id"), F.col("user_id")
        return self._events().where(F.col("event_type") == "error").select(
            key.alias("ticket_id"), "customer_id",
            F.date_sub(self.as_of, ((key * 11) % 400).cast("int")).alias("ticket_date"),
            _cases(key % 4, ["Billing", "Technical", "Account Access"], "Feature Request").alias("issue_type"),
            F.col("value").cast("decimal(6,1)").alias("resolution_time_hours"),
            (1 + (key * 3 + user) % 5).cast("int").alias("satisfaction_score"),
            F.when((key + user) % 5 == 3, "Escalated").when((key + user) % 5 == 4, "Closed - Unresolved")
            .otherwise("Resolved").alias("ticket_status"),
        )

    def marketing_campaigns(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.src("supplier").select(
            key.alias("campaign_id"),
            F.date_add(F.lit(dt.date(2000, 1, 1)), ((key * 17) % 600).cast("int")).alias("campaign_date"),
            _cases(key % 5, ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE"], "HOUSEHOLD").alias("channel"),
            _cases(key % 3, ["Promotion", "Retention"], "Awareness").alias("campaign_type"),
            F.abs("s_acctbal").cast("decimal(10,2)").alias("spend"),
        )

    def customer_campaign_interactions(self) -> DataFrame:
        key = F.col("event_id")
        # every campaign gets its share of the clicks, however many campaigns there are
        campaigns = self.src("supplier").agg(F.max("s_suppkey") + 1).scalar()
        clicks = self._events().where(F.col("event_type") == "click").withColumn("campaign_id", key % campaigns)
        return clicks.join(self.marketing_campaigns().select("campaign_id", "campaign_date"), "campaign_id").select(
            key.alias("interaction_id"), "customer_id", "campaign_id",
            _cases(key % 3, ["Click", "Email Open"], "Conversion").alias("interaction_type"),
            F.date_add("campaign_date", (key % 14).cast("int")).alias("interaction_date"),
        )


TABLE_NAMES = [
    "customers", "plans", "subscriptions", "transactions", "customer_activity", "support_tickets",
    "marketing_campaigns", "customer_campaign_interactions",
]


def clean_tables(spark: SparkSession, sf_dir: str) -> Tables:
    mapping = _Mapping(spark, sf_dir)
    return Tables({name: getattr(mapping, name) for name in TABLE_NAMES}, AS_OF)


# ---- deterministic defects ------------------------------------------------------------------------------------------


def _twice(df: DataFrame, repeated: Column) -> DataFrame:
    """Every row once with ingest_ord 0, rows matching ``repeated`` again with ingest_ord 1, in one scan."""
    copies = F.when(repeated, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("ingest_ord", F.explode(copies))


def _spoil(df: DataFrame, **rules: tuple[Column, Column]) -> DataFrame:
    """Replace column values under a condition; all conditions see the original values."""
    return df.withColumns({name: F.when(cond, bad).otherwise(F.col(name)) for name, (cond, bad) in rules.items()})


def raw_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The clean tables with defects injected by id arithmetic, so each audit count has an exact expectation."""
    t = clean_tables(spark, sf_dir)
    c, null = F.col, F.lit(None)
    far_id = 1_000_000_000
    first = c("ingest_ord") == 0

    def customers() -> DataFrame:
        key = c("customer_id")
        twice = _twice(t.customers, key % 101 == 9)
        return twice.withColumns({
            "gender": F.when(first & (key % 49 == 1), null).when(first & (key % 47 == 2), F.lower("gender"))
            .otherwise(c("gender")),
            "age": F.when(first & (key % 43 == 3), null).when(first & (key % 199 == 4), 150)
            .when(first & (key % 211 == 5), -5).otherwise(c("age")),
            "country": F.when(first & (key % 53 == 6), null).when(first & (key % 19 == 7), F.upper("country"))
            .otherwise(c("country")),
            "referral_source": F.when(first & (key % 59 == 8), null).otherwise(c("referral_source")),
        })

    def subscriptions() -> DataFrame:
        key = c("subscription_id")
        return _spoil(
            t.subscriptions,
            end_date=((key % 151 == 1) & (c("subscription_status") == "Cancelled"), F.date_sub("start_date", 10)),
            discount_percentage=(key % 97 == 2, null),
            subscription_status=(key % 101 == 3, F.lower("subscription_status")),
            cancellation_date=(key % 61 == 4, null),
            customer_id=(key % 499 == 7, c("customer_id") + far_id),
        )

    def transactions() -> DataFrame:
        key = c("transaction_id")
        charge = c("transaction_type") == "Subscription Charge"
        return _spoil(
            _twice(t.transactions, key % 113 == 5),
            customer_id=(first & (key % 401 == 1), c("customer_id") + far_id),
            subscription_id=(first & (key % 337 == 2), c("subscription_id") + far_id),
            amount=(first & (key % 251 == 3) & charge, -F.abs("amount")),
            payment_status=(first & (key % 101 == 4), null),
        )

    def customer_activity() -> DataFrame:
        key = c("activity_id")
        return _spoil(
            t.activity,
            customer_id=(key % 503 == 1, c("customer_id") + far_id),
            session_minutes=(key % 67 == 2, null),
            feature_usage_count=(key % 71 == 3, null),
        )

    def support_tickets() -> DataFrame:
        key = c("ticket_id")
        return _spoil(
            t.tickets,
            issue_type=(key % 23 == 1, F.lower("issue_type")),
            resolution_time_hours=(key % 31 == 2, null),
            satisfaction_score=(key % 37 == 3, null),
        )

    def interactions() -> DataFrame:
        key = c("interaction_id")
        return _spoil(t.interactions, customer_id=(key % 307 == 1, c("customer_id") + far_id))

    return Tables(
        {
            "customers": customers, "plans": t.plans, "subscriptions": subscriptions, "transactions": transactions,
            "customer_activity": customer_activity, "support_tickets": support_tickets,
            "marketing_campaigns": lambda: t.campaigns, "customer_campaign_interactions": interactions,
        },
        AS_OF,
    )
