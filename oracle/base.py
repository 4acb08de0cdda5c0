"""DuckDB CTEs that build the subscription tables from the driver's views.

``sql(body)`` prefixes exactly the CTEs the body needs. Everything is plain SQL
and independent of the Spark code it checks.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2001-09-01'"

CTES: dict[str, str] = {
    "customers": """
SELECT c.c_custkey AS customer_id, COALESCE(f.first_order, DATE '1995-01-01') AS signup_date,
       CASE WHEN c.c_custkey % 25 = 0 THEN 'Non-Binary' WHEN c.c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
       CAST(18 + (c.c_custkey * 7) % 60 AS INTEGER) AS age, 'Nation ' || SUBSTRING(n.n_name, 8) AS country,
       r.r_name AS region, c.c_mktsegment AS acquisition_channel,
       CASE c.c_custkey % 4 WHEN 0 THEN 'Colleague' WHEN 1 THEN 'Online Ad' WHEN 2 THEN 'App Store' ELSE 'Other' END
         AS referral_source
FROM customer c
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS first_order FROM orders GROUP BY o_custkey) f
       ON f.o_custkey = c.c_custkey""",
    "plans": """
SELECT * FROM (VALUES (1, 'Basic', 'Individual', CAST(9.99 AS DECIMAL(8,2)), 1, 0),
                      (2, 'Standard', 'Individual', 15.99, 2, 0),
                      (3, 'Premium', 'Family', 24.99, 5, 1),
                      (4, 'Enterprise', 'Team', 49.99, 20, 1))
  AS v(plan_id, plan_name, plan_type, monthly_price, max_devices, premium_support)""",
    "subscriptions": f"""
SELECT s.subscription_id, s.customer_id, s.plan_id, s.start_date, s.ended AS end_date, s.billing_cycle,
       CAST(ROUND(p.monthly_price * (100 - s.discount_percentage) / 100, 2) AS DECIMAL(8,2)) AS monthly_price,
       s.discount_percentage, s.subscription_status, s.ended AS cancellation_date,
       CASE WHEN s.subscription_status = 'Cancelled' THEN
         CASE s.subscription_id % 3 WHEN 0 THEN 'Too expensive' WHEN 1 THEN 'Not using enough' ELSE 'Missing features' END
       END AS cancellation_reason
FROM (SELECT o_orderkey AS subscription_id,
             CASE WHEN o_custkey % 7 = 3 THEN o_custkey - 1 ELSE o_custkey END AS customer_id,
             CAST(1 + o_orderkey % 4 AS INTEGER) AS plan_id, CAST(o_orderdate AS DATE) AS start_date,
             CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'Monthly' ELSE 'Annual' END AS billing_cycle,
             CAST(CASE o_orderkey % 7 WHEN 3 THEN 10 WHEN 4 THEN 15 WHEN 5 THEN 20 WHEN 6 THEN 30 ELSE 0 END AS INTEGER)
               AS discount_percentage,
             CASE WHEN o_orderstatus = 'F' THEN 'Cancelled' ELSE 'Active' END AS subscription_status,
             CASE WHEN o_orderstatus = 'F'
                  THEN LEAST(CAST(o_orderdate AS DATE) + CAST(20 + (o_orderkey * 13) % 700 AS INTEGER), {AS_OF}) END AS ended
      FROM orders) s
JOIN plans p ON p.plan_id = s.plan_id""",
    "transactions": f"""
SELECT (l.l_orderkey * 8 + l.l_linenumber) * 1000003 + CAST(ROUND(l.l_extendedprice * 100) AS BIGINT) % 1000003
         AS transaction_id,
       CASE WHEN o.o_custkey % 7 = 3 THEN o.o_custkey - 1 ELSE o.o_custkey END AS customer_id,
       l.l_orderkey AS subscription_id,
       LEAST(CAST(o.o_orderdate AS DATE) + 30 * (l.l_linenumber - 1), {AS_OF}) AS transaction_date,
       CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'O' THEN 'Add-on Purchase' ELSE 'Subscription Charge' END
         AS transaction_type,
       CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN -l.l_extendedprice ELSE l.l_extendedprice END
         AS DECIMAL(18,2)) AS amount,
       CAST(ROUND(CAST(l.l_extendedprice * l.l_discount AS DECIMAL(28,8)), 2) AS DECIMAL(18,2)) AS discount_amount,
       CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 'Refunded' WHEN l.l_returnflag = 'R' THEN 'Failed'
            ELSE 'Success' END AS payment_status
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "customer_activity": f"""
SELECT event_id AS activity_id, user_id * 10 + event_id % 10 AS customer_id,
       {AS_OF} - CAST((event_id * 7) % 120 AS INTEGER) AS activity_date,
       CAST(1 + FLOOR(value / 10) AS INTEGER) AS sessions, CAST(FLOOR(value * 3) AS INTEGER) AS session_minutes,
       CAST(FLOOR(value / 12) AS INTEGER) AS content_consumed, CAST(FLOOR(value / 25) AS INTEGER) AS feature_usage_count
FROM events WHERE event_type <> 'error'""",
    "support_tickets": f"""
SELECT event_id AS ticket_id, user_id * 10 + event_id % 10 AS customer_id,
       {AS_OF} - CAST((event_id * 11) % 400 AS INTEGER) AS ticket_date,
       CASE event_id % 4 WHEN 0 THEN 'Billing' WHEN 1 THEN 'Technical' WHEN 2 THEN 'Account Access'
            ELSE 'Feature Request' END AS issue_type,
       CAST(value AS DECIMAL(6,1)) AS resolution_time_hours, CAST(1 + (event_id * 3 + user_id) % 5 AS INTEGER) AS satisfaction_score,
       CASE (event_id + user_id) % 5 WHEN 3 THEN 'Escalated' WHEN 4 THEN 'Closed - Unresolved' ELSE 'Resolved' END
         AS ticket_status
FROM events WHERE event_type = 'error'""",
    "marketing_campaigns": """
SELECT s_suppkey AS campaign_id, DATE '2000-01-01' + CAST((s_suppkey * 17) % 600 AS INTEGER) AS campaign_date,
       CASE s_suppkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'AUTOMOBILE' WHEN 3 THEN 'FURNITURE'
            ELSE 'HOUSEHOLD' END AS channel,
       CASE s_suppkey % 3 WHEN 0 THEN 'Promotion' WHEN 1 THEN 'Retention' ELSE 'Awareness' END AS campaign_type,
       CAST(ABS(s_acctbal) AS DECIMAL(10,2)) AS spend
FROM supplier""",
    "customer_campaign_interactions": """
SELECT e.event_id AS interaction_id, e.user_id * 10 + e.event_id % 10 AS customer_id, m.campaign_id,
       CASE e.event_id % 3 WHEN 0 THEN 'Click' WHEN 1 THEN 'Email Open' ELSE 'Conversion' END AS interaction_type,
       m.campaign_date + CAST(e.event_id % 14 AS INTEGER) AS interaction_date
FROM events e JOIN marketing_campaigns m ON m.campaign_id = e.event_id % (SELECT MAX(s_suppkey) + 1 FROM supplier) WHERE e.event_type = 'click'""",
    # ---- defects
    "raw_customers": """
SELECT 0 AS ingest_ord, customer_id, signup_date,
       CASE WHEN customer_id % 49 = 1 THEN NULL WHEN customer_id % 47 = 2 THEN LOWER(gender) ELSE gender END AS gender,
       CASE WHEN customer_id % 43 = 3 THEN NULL WHEN customer_id % 199 = 4 THEN 150 WHEN customer_id % 211 = 5 THEN -5
            ELSE age END AS age,
       CASE WHEN customer_id % 53 = 6 THEN NULL WHEN customer_id % 19 = 7 THEN UPPER(country) ELSE country END AS country,
       region, acquisition_channel, CASE WHEN customer_id % 59 = 8 THEN NULL ELSE referral_source END AS referral_source
FROM customers
UNION ALL
SELECT 1, customer_id, signup_date, gender, age, country, region, acquisition_channel, referral_source
FROM customers WHERE customer_id % 101 = 9""",
    "raw_subscriptions": """
SELECT * REPLACE (
         CASE WHEN subscription_id % 151 = 1 AND subscription_status = 'Cancelled' THEN start_date - 10 ELSE end_date END AS end_date,
         CASE WHEN subscription_id % 97 = 2 THEN NULL ELSE discount_percentage END AS discount_percentage,
         CASE WHEN subscription_id % 101 = 3 THEN LOWER(subscription_status) ELSE subscription_status END AS subscription_status,
         CASE WHEN subscription_id % 61 = 4 THEN NULL ELSE cancellation_date END AS cancellation_date,
         CASE WHEN subscription_id % 499 = 7 THEN customer_id + 1000000000 ELSE customer_id END AS customer_id)
FROM subscriptions""",
    "raw_transactions": """
SELECT 0 AS ingest_ord, * REPLACE (
         CASE WHEN transaction_id % 401 = 1 THEN customer_id + 1000000000 ELSE customer_id END AS customer_id,
         CASE WHEN transaction_id % 337 = 2 THEN subscription_id + 1000000000 ELSE subscription_id END AS subscription_id,
         CASE WHEN transaction_id % 251 = 3 AND transaction_type = 'Subscription Charge' THEN -ABS(amount) ELSE amount END AS amount,
         CASE WHEN transaction_id % 101 = 4 THEN NULL ELSE payment_status END AS payment_status)
FROM transactions
UNION ALL SELECT 1, * FROM transactions WHERE transaction_id % 113 = 5""",
    "raw_customer_activity": """
SELECT * REPLACE (
         CASE WHEN activity_id % 503 = 1 THEN customer_id + 1000000000 ELSE customer_id END AS customer_id,
         CASE WHEN activity_id % 67 = 2 THEN NULL ELSE session_minutes END AS session_minutes,
         CASE WHEN activity_id % 71 = 3 THEN NULL ELSE feature_usage_count END AS feature_usage_count)
FROM customer_activity""",
    "raw_support_tickets": """
SELECT * REPLACE (
         CASE WHEN ticket_id % 23 = 1 THEN LOWER(issue_type) ELSE issue_type END AS issue_type,
         CASE WHEN ticket_id % 31 = 2 THEN NULL ELSE resolution_time_hours END AS resolution_time_hours,
         CASE WHEN ticket_id % 37 = 3 THEN NULL ELSE satisfaction_score END AS satisfaction_score)
FROM support_tickets""",
    "raw_interactions": """
SELECT * REPLACE (CASE WHEN interaction_id % 307 = 1 THEN customer_id + 1000000000 ELSE customer_id END AS customer_id)
FROM customer_campaign_interactions""",
    # ---- shared building blocks
    "newest": """
SELECT * FROM subscriptions
QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY start_date DESC, subscription_id DESC) = 1""",
    "paid": """
SELECT * FROM transactions WHERE transaction_type = 'Subscription Charge' AND payment_status = 'Success'""",
    "cust_revenue": "SELECT customer_id, SUM(amount) AS revenue FROM paid GROUP BY customer_id",
    "cust_usage": """
SELECT customer_id, AVG(sessions) AS m_sessions, AVG(session_minutes) AS m_minutes, AVG(feature_usage_count) AS m_features
FROM customer_activity GROUP BY customer_id""",
    "cust_support": """
SELECT customer_id, COUNT(*) AS tickets, AVG(satisfaction_score) AS m_sat,
       COUNT(*) FILTER (WHERE ticket_status = 'Closed - Unresolved') AS open_cases
FROM support_tickets GROUP BY customer_id""",
    # every customer with its newest subscription, if any
    "profile": """
SELECT c.*, n.subscription_id, n.plan_id, p.plan_name, n.billing_cycle, n.subscription_status, n.start_date, n.end_date,
       n.cancellation_date, n.monthly_price, n.discount_percentage,
       CAST(CASE WHEN n.subscription_status = 'Cancelled' THEN 1 ELSE 0 END AS INTEGER) AS gone
FROM customers c LEFT JOIN newest n USING (customer_id) LEFT JOIN plans p ON p.plan_id = n.plan_id""",
}


def rnd(expr: str, digits: int = 2) -> str:
    """Rounding on a fixed-point value, the same rule on both engines."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def share(part: str, whole: str, digits: int = 2) -> str:
    return rnd(f"100.0::DOUBLE * CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0)", digits)


def yearly(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return f"CASE {a}billing_cycle WHEN 'Monthly' THEN 12 * {a}monthly_price ELSE {a}monthly_price END"


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [name for name in CTES if name in words]


def sql(body: str, **extra: str) -> str:
    """``body`` with the CTEs it refers to, dependencies first; ``extra`` adds query-local CTEs."""
    ordered: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _needs(CTES[name]):
            if dep != name:
                visit(dep)
        ordered[name] = CTES[name]

    for text in [*extra.values(), body]:
        for name in _needs(text):
            visit(name)
    parts = [f"{name} AS ({text.strip()})" for name, text in [*ordered.items(), *extra.items()]]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
