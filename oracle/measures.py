"""Expected KPI measures, dashboard feeds and the model's inputs."""

from __future__ import annotations

from oracle.base import AS_OF, CTES, rnd, share, sql, yearly
from oracle.analysis import _hist, _monthly

HASH = "((customer_id % 2147483647) * 48271 + 42 * 69621) % 2147483647"
CTES.update({
    "split_rows": f"""SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY churn ORDER BY {HASH}, customer_id)
      <= CEIL(COUNT(*) OVER (PARTITION BY churn) * 0.25) THEN 'test' ELSE 'train' END AS split FROM feature_rows""",
    "train_rows": "SELECT * FROM split_rows WHERE split = 'train'",
})
NUMERIC = ("age monthly_price discount_percentage premium_support tenure_days avg_sessions avg_session_minutes avg_feature_usage "
           "engagement_trend_ratio total_tickets avg_satisfaction avg_resolution_time unresolved_tickets total_revenue "
           "total_transactions recency_days").split()

ANY_ACTIVE = "(SELECT COUNT(DISTINCT customer_id) FROM subscriptions WHERE subscription_status = 'Active')"
PEOPLE = "(SELECT COUNT(DISTINCT customer_id) FROM customers)"
MRR = rnd("CAST(SUM(monthly_price) FILTER (WHERE billing_cycle <> 'Annual') AS DOUBLE) "
          "+ CAST(SUM(monthly_price) FILTER (WHERE billing_cycle = 'Annual') AS DOUBLE) / 12", 4)


def _mean(name: str, column: str, table: str) -> str:
    return sql(f"SELECT AVG({column}) AS {name} FROM {table}")


def _growth(series: str, value: str, name: str) -> str:
    return f"""SELECT month, {value}, COALESCE((CAST({value} AS DOUBLE) - prev) / NULLIF(prev, 0), 0) AS {name}
        FROM (SELECT *, CAST(LAG({value}) OVER (ORDER BY month) AS DOUBLE) AS prev FROM {series}) g"""


ACTIVE_BY_PLAN = """SELECT plan_name, COUNT(DISTINCT customer_id) FILTER (WHERE subscription_status = 'Active') AS n
    FROM subscriptions JOIN plans USING (plan_id) GROUP BY 1"""
SIGNUPS = _monthly("customers", "signup_date", "COUNT(*)", "k")
TOTALS = "SELECT month, CAST(SUM(k) OVER (ORDER BY month) AS BIGINT) AS total_customers FROM signups"
REVENUE = _monthly("paid", "transaction_date", "SUM(amount)", "v")
# months from the first start or cancellation to the last
SUB_MONTHS = """SELECT CAST(UNNEST(generate_series(date_trunc('month', MIN(start_date)),
    date_trunc('month', GREATEST(MAX(start_date), MAX(cancellation_date))), INTERVAL 1 MONTH)) AS DATE) AS month FROM subscriptions"""
SUB_COUNTS = """SELECT month, (SELECT COUNT(*) FROM subscriptions WHERE date_trunc('month', start_date) <= month) AS started,
    (SELECT COUNT(*) FROM gone_subs WHERE date_trunc('month', cancellation_date) <= month) AS ended,
    (SELECT COUNT(*) FROM gone_subs WHERE date_trunc('month', cancellation_date) = month) AS cancellations FROM sub_months"""
GAPS = """SELECT dimension, value, {rate} AS r FROM (
    SELECT 'plan_name' AS dimension, plan_name AS value, gone FROM known UNION ALL SELECT 'billing_cycle', billing_cycle, gone FROM known
    UNION ALL SELECT 'region', region, gone FROM known UNION ALL SELECT 'acquisition_channel', acquisition_channel, gone FROM known
    UNION ALL SELECT 'age_group', CASE WHEN age < 25 THEN '1 - Under 25' WHEN age < 35 THEN '2 - 25-34' WHEN age < 45 THEN '3 - 35-44'
      WHEN age < 60 THEN '4 - 45-59' ELSE '5 - 60+' END, gone FROM known) x
    WHERE value IS NOT NULL GROUP BY ALL""".format(rate=share("SUM(gone)", "COUNT(*)"))
WIDEST = f"""SELECT dimension, arg_max(value, (r, value)) AS worst, MAX(r) AS worst_rate_pct, arg_min(value, (r, value)) AS best,
    MIN(r) AS best_rate_pct, {rnd('MAX(r) - MIN(r)')} AS gap_points FROM rates GROUP BY 1"""
KNOWN = "SELECT * FROM profile WHERE subscription_status IS NOT NULL"

QUERIES: dict[str, str] = {
    "m01_split": sql("SELECT customer_id, churn, split FROM split_rows"),
    "m02_preprocess": sql(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, {rnd(f'AVG({c})', 4)} AS mean, {rnd(f'STDDEV_SAMP({c})', 4)} AS deviation FROM train_rows"
        for c in NUMERIC)),
    "m03_class_weight": sql(f"""SELECT churn, COUNT(*) AS n,
        {rnd('CAST((SELECT COUNT(*) FROM train_rows) AS DOUBLE) / (2 * COUNT(*))', 6)} AS weight FROM train_rows GROUP BY 1"""),
    "k01_total_customers": sql(f"SELECT {PEOPLE} AS total_customers"),
    "k02_active_customers": sql(f"SELECT {ANY_ACTIVE} AS active_customers"),
    "k03_churned_customers": sql(f"SELECT {PEOPLE} - {ANY_ACTIVE} AS churned_customers"),
    "k04_new_customers": sql("SELECT CAST(date_trunc('month', signup_date) AS DATE) AS month, COUNT(*) AS new_customers FROM customers GROUP BY 1"),
    "k05_churn_rate": sql(f"SELECT CAST({PEOPLE} - {ANY_ACTIVE} AS DOUBLE) / {PEOPLE} AS churn_rate"),
    "k05_churn_rate_by_region": sql("""SELECT region, CAST(COUNT(*) - COUNT(a.customer_id) AS DOUBLE) / COUNT(*) AS churn_rate
        FROM customers LEFT JOIN (SELECT DISTINCT customer_id FROM subscriptions WHERE subscription_status = 'Active') a
        USING (customer_id) GROUP BY 1"""),
    "k06_retention_rate": sql(f"SELECT 1.0::DOUBLE - CAST({PEOPLE} - {ANY_ACTIVE} AS DOUBLE) / {PEOPLE} AS retention_rate"),
    "k03_churned_customers_by_plan": sql(f"SELECT plan_name, {PEOPLE} - n AS churned_customers FROM active_by_plan",
                                         active_by_plan=ACTIVE_BY_PLAN),
    "k05_churn_rate_by_plan": sql(f"SELECT plan_name, CAST({PEOPLE} - n AS DOUBLE) / {PEOPLE} AS churn_rate FROM active_by_plan",
                                  active_by_plan=ACTIVE_BY_PLAN),
    "k05_churn_rate_by_month": sql(f"""SELECT month, CAST({PEOPLE} - n AS DOUBLE) / {PEOPLE} AS churn_rate FROM (
        SELECT CAST(date_trunc('month', start_date) AS DATE) AS month,
               COUNT(DISTINCT customer_id) FILTER (WHERE subscription_status = 'Active') AS n FROM subscriptions GROUP BY 1) x"""),
    "k06_retention_rate_by_plan": sql(
        f"SELECT plan_name, 1.0::DOUBLE - CAST({PEOPLE} - n AS DOUBLE) / {PEOPLE} AS retention_rate FROM active_by_plan",
        active_by_plan=ACTIVE_BY_PLAN),
    "k13_arpu_by_plan": sql(f"""SELECT plan_name, CAST(SUM(amount) AS DOUBLE) / {PEOPLE} AS arpu
        FROM paid JOIN subscriptions s USING (subscription_id) JOIN plans USING (plan_id) GROUP BY 1"""),
    "k14_revenue_lost_by_cancellation_month": sql(f"""SELECT CAST(date_trunc('month', cancellation_date) AS DATE) AS month,
        CAST(SUM({yearly()}) AS DOUBLE) AS revenue_lost FROM gone_subs WHERE cancellation_date IS NOT NULL GROUP BY 1"""),
    "k07_customer_growth": sql(_growth("totals", "total_customers", "customer_growth"), signups=SIGNUPS, totals=TOTALS),
    "k08_avg_tenure": sql(f"""SELECT AVG(date_diff('day', start_date, COALESCE(cancellation_date, {AS_OF}))) AS avg_tenure_days
        FROM subscriptions"""),
    "k09_total_revenue": sql("SELECT CAST(SUM(amount) AS DOUBLE) AS total_revenue FROM paid"),
    "k09_total_revenue_by_plan_region": sql("""SELECT plan_name, region, CAST(SUM(amount) AS DOUBLE) AS total_revenue
        FROM paid JOIN subscriptions s USING (subscription_id) JOIN plans USING (plan_id)
        JOIN customers c ON c.customer_id = paid.customer_id GROUP BY ALL"""),
    "k10_monthly_revenue": sql("SELECT month, CAST(v AS DOUBLE) AS monthly_revenue FROM filled", filled=REVENUE),
    "k11_mrr": sql(f"SELECT {MRR} AS mrr FROM subscriptions WHERE subscription_status = 'Active'"),
    "k11_mrr_by_plan": sql(f"""SELECT plan_name, {MRR} AS mrr FROM (SELECT s.*, plan_name FROM subscriptions s JOIN plans USING (plan_id)) x
        WHERE subscription_status = 'Active' GROUP BY 1"""),
    "k12_revenue_growth": sql(_growth("series", "monthly_revenue", "revenue_growth"), filled=REVENUE,
                              series="SELECT month, CAST(v AS DOUBLE) AS monthly_revenue FROM filled"),
    "k13_arpu": sql(f"SELECT CAST(SUM(amount) AS DOUBLE) / {PEOPLE} AS arpu FROM paid"),
    "k13_arpu_by_segment": sql("""SELECT segment, CAST(SUM(COALESCE(revenue, 0)) AS DOUBLE) / COUNT(*) AS arpu
        FROM rfm_named LEFT JOIN cust_revenue USING (customer_id) GROUP BY 1"""),
    "k14_revenue_lost": sql(f"SELECT CAST(SUM({yearly()}) AS DOUBLE) AS revenue_lost FROM gone_subs"),
    "k16_clv": sql("SELECT CAST(SUM(revenue) AS DOUBLE) / COUNT(*) AS clv FROM cust_revenue"),
    "k17_avg_sessions": _mean("avg_sessions", "sessions", "customer_activity"),
    "k18_avg_duration": _mean("avg_session_duration", "session_minutes", "customer_activity"),
    "k19_feature_usage": _mean("feature_usage", "feature_usage_count", "customer_activity"),
    "k20_support_tickets": sql("SELECT COUNT(*) AS support_tickets FROM support_tickets"),
    "k21_avg_satisfaction": _mean("avg_satisfaction", "satisfaction_score", "support_tickets"),
    "k21_avg_satisfaction_by_channel": sql("""SELECT acquisition_channel, AVG(satisfaction_score) AS avg_satisfaction
        FROM support_tickets JOIN customers USING (customer_id) GROUP BY 1"""),
    "k26_date_dimension": sql(f"""SELECT d AS date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
        monthname(d) AS month_name, strftime(d, '%Y-%m') AS year_month
        FROM (SELECT CAST(UNNEST(generate_series(LEAST((SELECT MIN(signup_date) FROM customers), (SELECT MIN(start_date) FROM subscriptions),
          (SELECT MIN(transaction_date) FROM transactions), (SELECT MIN(activity_date) FROM customer_activity),
          (SELECT MIN(ticket_date) FROM support_tickets)), {AS_OF}, INTERVAL 1 DAY)) AS DATE) AS d) x"""),
    "k27_headline_snapshot": sql(f"""SELECT COUNT(*) AS total_customers, CAST(SUM(gone) AS BIGINT) AS churned_customers,
        CAST(COUNT(*) - SUM(gone) AS BIGINT) AS active_customers, {share('SUM(gone)', 'COUNT(*)')} AS overall_churn_rate_pct,
        {share("SUM(gone) FILTER (WHERE billing_cycle = 'Monthly')", "COUNT(*) FILTER (WHERE billing_cycle = 'Monthly')")} AS churn_monthly_pct,
        {share("SUM(gone) FILTER (WHERE billing_cycle = 'Annual')", "COUNT(*) FILTER (WHERE billing_cycle = 'Annual')")} AS churn_annual_pct,
        (SELECT COUNT(*) FROM subscriptions) AS total_subscriptions, (SELECT COUNT(*) FROM transactions) AS total_transactions,
        (SELECT CAST(SUM(amount) AS DOUBLE) FROM paid) AS total_revenue,
        {rnd('(SELECT CAST(SUM(amount) AS DOUBLE) FROM paid) / COUNT(*)')} AS arpu,
        (SELECT CAST(SUM({yearly()}) AS DOUBLE) FROM gone_subs) AS annualized_revenue_lost_to_churn FROM profile"""),
    "d01_cumulative_customers": sql("SELECT month, total_customers AS customers FROM totals", signups=SIGNUPS, totals=TOTALS),
    "d02_churn_combo": sql(f"SELECT month, cancellations, {share('cancellations', 'started', 3)} AS churn_rate_pct FROM counts",
                           sub_months=SUB_MONTHS, counts=SUB_COUNTS),
    "d03_retention_trend": sql(f"SELECT month, {share('started - ended', 'started', 3)} AS retention_rate_pct FROM counts",
                               sub_months=SUB_MONTHS, counts=SUB_COUNTS),
    "d04_mrr_trend": sql(f"""SELECT month, {rnd("COALESCE(CAST(SUM(monthly_price) FILTER (WHERE billing_cycle <> 'Annual') AS DOUBLE), 0) "
        "+ COALESCE(CAST(SUM(monthly_price) FILTER (WHERE billing_cycle = 'Annual') AS DOUBLE), 0) / 12", 4)} AS mrr
        FROM sub_months LEFT JOIN subscriptions ON start_date <= last_day(month) AND (end_date IS NULL OR end_date > last_day(month))
        GROUP BY 1""", sub_months=SUB_MONTHS.replace("cancellation_date", "end_date")),
    "d05_revenue_lost_trend": sql(f"""SELECT strftime(cancellation_date, '%Y-%m') AS month,
        CAST(SUM({yearly()}) AS DOUBLE) AS annualized_revenue_lost FROM gone_subs GROUP BY 1"""),
    "d07_segment_feed": sql(f"""SELECT segment, COUNT(*) AS customers, CAST(SUM(exact_monetary) AS DOUBLE) AS total_revenue,
        {share("COUNT(*) FILTER (WHERE subscription_status = 'Cancelled')", 'COUNT(*)')} AS churn_rate FROM rfm_named GROUP BY 1"""),
    "d07_tenure_histogram": sql("SELECT bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, n FROM h",
                                aged=f"SELECT date_diff('day', signup_date, {AS_OF}) // 30 AS age_months FROM customers",
                                h=_hist("aged", "age_months", 24)),
    "d08_churn_gaps": sql("SELECT * FROM widest", known=KNOWN, rates=GAPS, widest=WIDEST),
    "d08_top_finding": sql("""SELECT *, format('{}: {} customers churn at {:.2f}% against {:.2f}% for {}', dimension, worst,
        worst_rate_pct, best_rate_pct, best) AS finding FROM widest ORDER BY gap_points DESC, dimension LIMIT 1""",
        known=KNOWN, rates=GAPS, widest=WIDEST),
}
