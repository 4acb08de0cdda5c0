"""Expected audits, cleaned tables and integrity reports on the defect-bearing tables."""

from __future__ import annotations

from oracle.base import AS_OF, CTES, share, sql

RAW_OF = {
    "customers": "raw_customers", "plans": "plans", "subscriptions": "raw_subscriptions",
    "transactions": "raw_transactions", "customer_activity": "raw_customer_activity",
    "support_tickets": "raw_support_tickets", "marketing_campaigns": "marketing_campaigns",
    "customer_campaign_interactions": "raw_interactions",
}


def title(x: str) -> str:
    """Capitalise after a space or a hyphen."""
    word = "UPPER(SUBSTRING(w, 1, 1)) || LOWER(SUBSTRING(w, 2))"
    inner = f"array_to_string(list_transform(string_split(p, ' '), lambda w: {word}), ' ')"
    return f"array_to_string(list_transform(string_split(TRIM({x}), '-'), lambda p: {inner}), '-')"


def lower_only(x: str) -> str:
    return f"({x} = LOWER({x}) AND {x} <> UPPER({x}))"


CTES.update({
    "one_customer": """SELECT * FROM raw_customers
QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ingest_ord) = 1""",
    "aged_customer": """SELECT * REPLACE (CASE WHEN age BETWEEN 13 AND 100 THEN age END AS age) FROM one_customer""",
    "fixed_customers": f"""SELECT customer_id, signup_date, COALESCE({title('gender')}, 'Unknown') AS gender,
  CAST(round_even(COALESCE(CAST(age AS DOUBLE), MEDIAN(age) OVER (PARTITION BY region)), 0) AS INTEGER) AS age,
  COALESCE({title('country')}, 'Unknown') AS country, COALESCE(region, 'Unknown') AS region, acquisition_channel,
  COALESCE(referral_source, 'Not Captured') AS referral_source FROM aged_customer""",
    "cased_subscriptions": f"SELECT * REPLACE ({title('subscription_status')} AS subscription_status) FROM raw_subscriptions",
    "dated_subscriptions": f"""SELECT * REPLACE (CASE WHEN subscription_status = 'Cancelled'
  THEN COALESCE(cancellation_date, end_date, {AS_OF}) ELSE cancellation_date END AS cancellation_date,
  COALESCE(discount_percentage, 0) AS discount_percentage) FROM cased_subscriptions""",
    "fixed_subscriptions": """SELECT * REPLACE (
  CASE WHEN end_date < start_date THEN NULL ELSE cancellation_date END AS cancellation_date,
  CASE WHEN end_date < start_date THEN 'Active' ELSE subscription_status END AS subscription_status,
  CASE WHEN end_date < start_date THEN NULL ELSE end_date END AS end_date) FROM dated_subscriptions""",
    "one_txn": """SELECT * FROM raw_transactions QUALIFY ROW_NUMBER() OVER (
  PARTITION BY customer_id, subscription_id, transaction_date, transaction_type, amount
  ORDER BY ingest_ord, transaction_id, discount_amount, payment_status NULLS FIRST) = 1""",
    "sub_txn": "SELECT * FROM one_txn WHERE subscription_id IN (SELECT subscription_id FROM raw_subscriptions)",
    "fixed_transactions": """SELECT * EXCLUDE (ingest_ord) REPLACE (
  CASE WHEN transaction_type = 'Subscription Charge' AND amount < 0 AND payment_status IS DISTINCT FROM 'Refunded'
       THEN ABS(amount) ELSE amount END AS amount,
  COALESCE(payment_status, 'Unknown') AS payment_status)
FROM sub_txn WHERE customer_id IN (SELECT customer_id FROM raw_customers)""",
    "fixed_activity": """SELECT * REPLACE (
  COALESCE(CAST(session_minutes AS DOUBLE), (SELECT MEDIAN(session_minutes) FROM raw_customer_activity)) AS session_minutes,
  COALESCE(feature_usage_count, 0) AS feature_usage_count)
FROM raw_customer_activity WHERE customer_id IN (SELECT customer_id FROM raw_customers)""",
    "fixed_tickets": f"""SELECT * REPLACE ({title('issue_type')} AS issue_type,
  COALESCE(CAST(satisfaction_score AS DOUBLE), (SELECT MEDIAN(satisfaction_score) FROM raw_support_tickets)) AS satisfaction_score,
  COALESCE(CAST(resolution_time_hours AS DOUBLE),
           (SELECT MEDIAN(CAST(resolution_time_hours AS DOUBLE)) FROM raw_support_tickets)) AS resolution_time_hours)
FROM raw_support_tickets""",
    "fixed_interactions": "SELECT * FROM raw_interactions WHERE customer_id IN (SELECT customer_id FROM raw_customers)",
})

FIXED_OF = {
    "customers": "fixed_customers", "subscriptions": "fixed_subscriptions", "transactions": "fixed_transactions",
    "customer_activity": "fixed_activity", "support_tickets": "fixed_tickets",
    "customer_campaign_interactions": "fixed_interactions",
}

UNKNOWN_CUST = "customer_id NOT IN (SELECT customer_id FROM raw_customers)"

# issue -> (counted rows: table and condition, or a full count expression; size of the checked table)
AUDITS: dict[str, tuple[str, str]] = {
    "duplicate_customers": ("(SELECT COUNT(*) - COUNT(DISTINCT customer_id) FROM raw_customers)", "raw_customers"),
    "country_case": ("one_customer WHERE country = UPPER(country) AND country <> LOWER(country)", "one_customer"),
    "gender_case": (f"one_customer WHERE {lower_only('gender')}", "one_customer"),
    "invalid_age": ("one_customer WHERE age < 13 OR age > 100", "one_customer"),
    "missing_age": ("aged_customer WHERE age IS NULL", "one_customer"),
    "missing_gender": ("one_customer WHERE gender IS NULL", "one_customer"),
    "missing_country": ("one_customer WHERE country IS NULL", "one_customer"),
    "missing_referral": ("one_customer WHERE referral_source IS NULL", "one_customer"),
    "status_case": (f"raw_subscriptions WHERE {lower_only('subscription_status')}", "raw_subscriptions"),
    "cancelled_without_date": (
        "cased_subscriptions WHERE subscription_status = 'Cancelled' AND cancellation_date IS NULL", "raw_subscriptions"),
    "missing_discount": ("raw_subscriptions WHERE discount_percentage IS NULL", "raw_subscriptions"),
    "end_before_start": ("raw_subscriptions WHERE end_date < start_date", "raw_subscriptions"),
    "duplicate_transactions": (
        "(SELECT (SELECT COUNT(*) FROM raw_transactions) - (SELECT COUNT(*) FROM one_txn))", "raw_transactions"),
    "orphan_subscription": (
        "one_txn WHERE subscription_id NOT IN (SELECT subscription_id FROM raw_subscriptions)", "raw_transactions"),
    "negative_charge": ("""sub_txn WHERE transaction_type = 'Subscription Charge' AND amount < 0
        AND payment_status IS DISTINCT FROM 'Refunded'""", "sub_txn"),
    "missing_payment_status": ("sub_txn WHERE payment_status IS NULL", "sub_txn"),
    "orphan_customer": (f"sub_txn WHERE {UNKNOWN_CUST}", "sub_txn"),
    "missing_minutes": ("raw_customer_activity WHERE session_minutes IS NULL", "raw_customer_activity"),
    "missing_features": ("raw_customer_activity WHERE feature_usage_count IS NULL", "raw_customer_activity"),
    "orphan_activity": (f"raw_customer_activity WHERE {UNKNOWN_CUST}", "raw_customer_activity"),
    "issue_case": (f"raw_support_tickets WHERE {lower_only('issue_type')}", "raw_support_tickets"),
    "missing_satisfaction": ("raw_support_tickets WHERE satisfaction_score IS NULL", "raw_support_tickets"),
    "missing_resolution": ("raw_support_tickets WHERE resolution_time_hours IS NULL", "raw_support_tickets"),
    "orphan_interactions": (f"raw_interactions WHERE {UNKNOWN_CUST}", "raw_interactions"),
}


def audit_rows(*issues: str) -> str:
    parts = []
    for issue in issues:
        hit, table = AUDITS[issue]
        count = hit if hit.startswith("(") else f"(SELECT COUNT(*) FROM {hit})"
        parts.append(f"SELECT '{issue}' AS issue, {count} AS affected, (SELECT COUNT(*) FROM {table}) AS total")
    return " UNION ALL ".join(parts)


def audit_sql(*issues: str) -> str:
    return sql(f"SELECT issue, affected, total, {share('affected', 'total', 3)} AS pct FROM counted",
               counted=audit_rows(*issues))


CL_KEYS: dict[str, tuple[str, ...]] = {
    "cl01_dedupe_customers": ("duplicate_customers",), "cl02_title_country": ("country_case",),
    "cl03_title_gender": ("gender_case",), "cl04_invalid_age": ("invalid_age",), "cl05_impute_age": ("missing_age",),
    "cl06_fill_customer_labels": ("missing_gender", "missing_country", "missing_referral"),
    "cl07_std_status": ("status_case",), "cl08_backfill_cancel_date": ("cancelled_without_date",),
    "cl09_fill_discount": ("missing_discount",), "cl10_reset_bad_dates": ("end_before_start",),
    "cl11_dedupe_txn": ("duplicate_transactions",), "cl12_orphan_txn_sub": ("orphan_subscription",),
    "cl13_abs_negative_charge": ("negative_charge",), "cl14_fill_payment_status": ("missing_payment_status",),
    "cl15_orphan_txn_cust": ("orphan_customer",), "cl16_impute_minutes": ("missing_minutes",),
    "cl17_fill_feature_usage": ("missing_features",), "cl18_orphan_activity": ("orphan_activity",),
    "cl19_std_issue_type": ("issue_case",), "cl20_impute_satisfaction": ("missing_satisfaction",),
    "cl21_impute_resolution": ("missing_resolution",), "cl22_orphan_interactions": ("orphan_interactions",),
}


def _orphans(child: str, key: str, parent: str, parent_key: str) -> str:
    return f"""SELECT '{child}' AS child, '{key}' AS child_column, '{parent}' AS parent,
      (SELECT COUNT(*) FROM {RAW_OF[child]} WHERE {key} NOT IN (SELECT {parent_key} FROM {RAW_OF[parent]})) AS orphans"""


def _violations() -> str:
    rules = {
        "customers": [("signup_date_not_null", "signup_date IS NULL"), ("age_in_range", "age NOT BETWEEN 13 AND 100")],
        "plans": [("plan_name_not_null", "plan_name IS NULL"), ("monthly_price_not_null", "monthly_price IS NULL"),
                  ("monthly_price_non_negative", "monthly_price < 0"), ("premium_support_flag", "premium_support NOT IN (0, 1)")],
        "subscriptions": [
            ("customer_id_not_null", "customer_id IS NULL"), ("plan_id_not_null", "plan_id IS NULL"),
            ("start_date_not_null", "start_date IS NULL"), ("monthly_price_not_null", "monthly_price IS NULL"),
            ("billing_cycle_domain", "billing_cycle NOT IN ('Monthly', 'Annual')"),
            ("monthly_price_non_negative", "monthly_price < 0"),
            ("discount_in_range", "discount_percentage NOT BETWEEN 0 AND 100"),
            ("status_domain", "subscription_status NOT IN ('Active', 'Cancelled')"),
            ("end_not_before_start", "end_date < start_date")],
        "transactions": [("customer_id_not_null", "customer_id IS NULL"), ("subscription_id_not_null", "subscription_id IS NULL"),
                         ("transaction_date_not_null", "transaction_date IS NULL"), ("amount_not_null", "amount IS NULL")],
        "customer_activity": [("customer_id_not_null", "customer_id IS NULL"), ("activity_date_not_null", "activity_date IS NULL")],
        "support_tickets": [("customer_id_not_null", "customer_id IS NULL"), ("ticket_date_not_null", "ticket_date IS NULL"),
                            ("satisfaction_in_range", "satisfaction_score NOT BETWEEN 1 AND 5")],
        "marketing_campaigns": [("campaign_date_not_null", "campaign_date IS NULL")],
        "customer_campaign_interactions": [
            ("customer_id_not_null", "customer_id IS NULL"), ("campaign_id_not_null", "campaign_id IS NULL"),
            ("interaction_date_not_null", "interaction_date IS NULL")],
    }
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{n}' AS check_name, (SELECT COUNT(*) FROM {RAW_OF[t]} WHERE {cond}) AS violations"
        for t, checks in rules.items() for n, cond in checks)


QUERIES: dict[str, str] = {
    **{key: audit_sql(*issues) for key, issues in CL_KEYS.items()},
    "cl23_quality_totals": sql("SELECT COUNT(*) AS checks, CAST(SUM(affected) AS BIGINT) AS records_affected FROM counted",
                               counted=audit_rows(*AUDITS)),
    "cl23_quality_report": audit_sql(*AUDITS),
    "cl24_row_deltas": sql(" UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, r AS raw_rows, p AS processed_rows, r - p AS removed
            FROM (SELECT (SELECT COUNT(*) FROM {RAW_OF[t]}) AS r, (SELECT COUNT(*) FROM {FIXED_OF[t]}) AS p) x{i}"""
        for i, t in enumerate(FIXED_OF) if t != "customer_campaign_interactions")),
    "cl25_raw_defect_profile": sql(f"""SELECT COUNT(*) - COUNT(DISTINCT customer_id) AS duplicate_customer_ids,
        COUNT(*) - COUNT(age) AS missing_ages, COUNT(*) FILTER (WHERE age < 0 OR age > 100) AS ages_out_of_range,
        COUNT(*) FILTER (WHERE country = UPPER(country) AND country <> LOWER(country)) AS uppercase_countries,
        (SELECT {share("COUNT(*) FILTER (WHERE LOWER(subscription_status) = 'cancelled')", 'COUNT(*)')} FROM raw_subscriptions)
          AS raw_churn_rate_pct FROM raw_customers"""),
    "cl25_raw_status_counts": sql("SELECT subscription_status, COUNT(*) AS n FROM raw_subscriptions GROUP BY 1"),
    "cl26_post_clean_checks": sql("""SELECT COUNT(*) - COUNT(DISTINCT customer_id) AS duplicate_customer_ids,
        COUNT(*) FILTER (WHERE age < 13 OR age > 100) AS ages_out_of_range,
        (SELECT COUNT(*) FROM fixed_subscriptions WHERE subscription_status = 'Cancelled' AND cancellation_date IS NULL)
          AS cancelled_without_date,
        (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT subscription_status AS s FROM fixed_subscriptions) d)
          AS distinct_statuses FROM fixed_customers"""),
    "clean_customers": sql("SELECT * FROM fixed_customers"),
    "clean_subscriptions": sql("SELECT * FROM fixed_subscriptions"),
    "clean_transactions": sql("SELECT * FROM fixed_transactions"),
    "clean_activity": sql("SELECT * FROM fixed_activity"),
    "clean_tickets": sql("SELECT * FROM fixed_tickets"),
    "clean_interactions": sql("SELECT * FROM fixed_interactions"),
    "dq01_row_counts": sql(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {raw}" for t, raw in RAW_OF.items())),
    "dq02_duplicate_customers": sql("SELECT customer_id, COUNT(*) AS n FROM raw_customers GROUP BY 1 HAVING COUNT(*) > 1"),
    "dq03_orphan_subscriptions": sql(
        f"SELECT subscription_id FROM raw_subscriptions WHERE {UNKNOWN_CUST}"),
    "dq04_orphan_transactions": sql("""SELECT transaction_id FROM raw_transactions
        WHERE subscription_id NOT IN (SELECT subscription_id FROM raw_subscriptions)"""),
    "dq05_cancelled_without_date": sql("""SELECT subscription_id FROM raw_subscriptions
        WHERE subscription_status = 'Cancelled' AND cancellation_date IS NULL"""),
    "dq06_end_before_start": sql("SELECT subscription_id FROM raw_subscriptions WHERE end_date < start_date"),
    "dq07_negative_charges": sql("""SELECT transaction_id FROM raw_transactions
        WHERE transaction_type = 'Subscription Charge' AND amount < 0 AND payment_status <> 'Refunded'"""),
    "dq08_age_bounds": sql("SELECT customer_id, age FROM raw_customers WHERE age NOT BETWEEN 13 AND 100"),
    "dq09_null_audit": sql("""SELECT COUNT(*) - COUNT(gender) AS null_gender, COUNT(*) - COUNT(country) AS null_country,
        COUNT(*) - COUNT(age) AS null_age FROM raw_customers"""),
    "dq10a_distinct_status": sql("SELECT DISTINCT subscription_status FROM raw_subscriptions"),
    "dq10b_distinct_billing": sql("SELECT DISTINCT billing_cycle FROM raw_subscriptions"),
    "dq10c_distinct_issue_type": sql("SELECT DISTINCT issue_type FROM raw_support_tickets"),
    "dq11_check_constraints": sql(_violations()),
    "dq12_foreign_keys": sql(" UNION ALL ".join(_orphans(*fk) for fk in [
        ("subscriptions", "customer_id", "customers", "customer_id"), ("subscriptions", "plan_id", "plans", "plan_id"),
        ("transactions", "customer_id", "customers", "customer_id"),
        ("transactions", "subscription_id", "subscriptions", "subscription_id"),
        ("customer_activity", "customer_id", "customers", "customer_id"),
        ("support_tickets", "customer_id", "customers", "customer_id"),
        ("customer_campaign_interactions", "customer_id", "customers", "customer_id"),
        ("customer_campaign_interactions", "campaign_id", "marketing_campaigns", "campaign_id")])),
    "dq13_grain": sql(" UNION ALL ".join(
        f"""SELECT '{t}' AS relation, (SELECT COUNT(*) FROM (SELECT {k} FROM {RAW_OF[t]} GROUP BY {k} HAVING COUNT(*) > 1) d)
            AS repeated_keys""" for t, k in (("customers", "customer_id"), ("plans", "plan_id"),
                                             ("subscriptions", "subscription_id"), ("marketing_campaigns", "campaign_id")))),
}
