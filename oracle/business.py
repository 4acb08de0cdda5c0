"""Expected results of q01-q47, the customer view and the cohort tables."""

from __future__ import annotations

from oracle.base import AS_OF, rnd, share, sql, yearly

GONE = "COUNT(*) FILTER (WHERE subscription_status = 'Cancelled')"
MONTH = "strftime({0}, '%Y-%m')".format


def _cases(x: str, cuts, labels) -> str:
    whens = " ".join(f"WHEN {x} < {cut} THEN '{label}'" for cut, label in zip(cuts, labels))
    return f"CASE {whens} ELSE '{labels[-1]}' END"


def _mix(key: str) -> str:
    return sql(f"""SELECT {key}, COUNT(*) AS customers, {share('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_total
                   FROM customers GROUP BY {key}""")


def _churn(key: str, source: str, total: str = "total_subs") -> str:
    return sql(f"""SELECT {key.split(' AS ')[-1]}, COUNT(*) AS {total}, {GONE} AS churned, {share(GONE, 'COUNT(*)')} AS churn_rate_pct
                   FROM (SELECT {key}, subscription_status FROM {source}) g GROUP BY 1""")


def _tile(source: str, value: str, k: int, way: str = "") -> str:
    return f"SELECT *, NTILE({k}) OVER (ORDER BY {value} {way}, customer_id) AS tile FROM {source}"


SUBS_WITH_CUSTOMER = "subscriptions JOIN customers USING (customer_id)"
AT_RISK = f"""SELECT n.*, {yearly('n')} AS worth FROM newest n LEFT JOIN cust_support USING (customer_id)
WHERE n.subscription_status = 'Active' AND COALESCE(m_sat, 5) <= 3"""
FALLING = f"""SELECT n.customer_id FROM newest n JOIN (
  SELECT customer_id, AVG(sessions) FILTER (WHERE activity_date >= {AS_OF} - 31) AS late,
         AVG(sessions) FILTER (WHERE activity_date < {AS_OF} - 31 AND activity_date >= {AS_OF} - 92) AS early
  FROM customer_activity GROUP BY customer_id) w USING (customer_id)
WHERE n.subscription_status = 'Active' AND late < 0.6::DOUBLE * early"""
FIRST = """SELECT customer_id, MIN(start_date) AS born,
  MIN(cancellation_date) FILTER (WHERE subscription_status = 'Cancelled') AS died FROM subscriptions GROUP BY customer_id"""
REV_TILE = _tile("cust_revenue", "revenue", 4)


def _risk(key: str, joins: str) -> str:
    return sql(f"SELECT {key}, CAST(SUM(worth) AS DOUBLE) AS at_risk_revenue FROM threatened {joins} GROUP BY {key}",
               threatened=AT_RISK)


def _kept(days: int) -> str:
    return f"COUNT(*) FILTER (WHERE died IS NULL OR died >= born + {days})"


COHORT_LONG = f"""SELECT {MONTH('born')} AS cohort_month, 'M' || m AS milestone, COUNT(*) AS cohort_size,
  COUNT(*) FILTER (WHERE died IS NULL OR died >= due) AS retained,
  {share('COUNT(*) FILTER (WHERE died IS NULL OR died >= due)', 'COUNT(*)', 1)} AS retention_pct
FROM (SELECT lives.*, m, CAST(born + to_months(m) AS DATE) AS due
      FROM lives CROSS JOIN (VALUES (0), (1), (2), (3), (6), (12)) v(m)) x
WHERE due <= {AS_OF} GROUP BY 1, 2"""

QUERIES: dict[str, str] = {
    "q01_total_customers": sql("SELECT COUNT(*) AS total_customers FROM customers"),
    "q02_active_customers": sql("SELECT COUNT(*) AS active_customers FROM newest WHERE subscription_status = 'Active'"),
    "q03_churned_customers": sql("SELECT COUNT(*) AS churned_customers FROM newest WHERE subscription_status = 'Cancelled'"),
    "q04_new_customers_by_month": sql(
        f"SELECT {MONTH('signup_date')} AS signup_month, COUNT(*) AS new_customers FROM customers GROUP BY 1"),
    "q05_customers_by_region": _mix("region"),
    "q06_customers_by_channel": _mix("acquisition_channel"),
    "q07_customers_by_plan": sql("SELECT plan_name, COUNT(*) AS customers FROM newest JOIN plans USING (plan_id) GROUP BY 1"),
    "q08_customers_by_tenure": sql(f"""SELECT {_cases(f"(date_diff('day', signup_date, {AS_OF}) // 30)", (3, 6, 12, 18),
        ('1 - 0-2 months', '2 - 3-5 months', '3 - 6-11 months', '4 - 12-17 months', '5 - 18+ months'))} AS tenure_bucket,
        COUNT(*) AS customers FROM customers GROUP BY 1"""),
    "q09_total_revenue": sql("SELECT CAST(SUM(amount) AS DOUBLE) AS total_revenue FROM paid"),
    "q10_monthly_revenue": sql(
        f"SELECT {MONTH('transaction_date')} AS revenue_month, CAST(SUM(amount) AS DOUBLE) AS revenue FROM paid GROUP BY 1"),
    "q11_mom_growth": sql(
        f"""SELECT revenue_month, CAST(r AS DOUBLE) AS revenue, {share('r - prev', 'prev')} AS mom_growth_pct
            FROM (SELECT *, LAG(r) OVER (ORDER BY revenue_month) AS prev FROM per_month) x""",
        per_month=f"SELECT {MONTH('transaction_date')} AS revenue_month, SUM(amount) AS r FROM paid GROUP BY 1"),
    "q12_revenue_by_plan": sql(f"""SELECT plan_name, CAST(SUM(amount) AS DOUBLE) AS revenue,
        {share('SUM(amount)', '(SELECT SUM(amount) FROM paid)')} AS pct_of_total
        FROM paid JOIN subscriptions s USING (subscription_id) JOIN plans USING (plan_id) GROUP BY plan_name"""),
    "q13_revenue_by_region": sql(
        "SELECT region, CAST(SUM(amount) AS DOUBLE) AS revenue FROM paid JOIN customers USING (customer_id) GROUP BY 1"),
    "q14_revenue_by_channel": sql("""SELECT acquisition_channel, CAST(SUM(amount) AS DOUBLE) AS revenue
        FROM paid JOIN customers USING (customer_id) GROUP BY 1"""),
    "q15_arpu": sql(f"""SELECT {rnd('CAST((SELECT SUM(amount) FROM paid) AS DOUBLE) / COUNT(DISTINCT customer_id)')} AS arpu_all_time
        FROM customers"""),
    "q16_revenue_lost": sql(f"""SELECT CAST(SUM({yearly()}) AS DOUBLE) AS annualized_revenue_lost_to_churn
        FROM subscriptions WHERE subscription_status = 'Cancelled'"""),
    "q17_naive_revenue_at_risk": sql(f"""SELECT CAST(SUM({yearly()}) AS DOUBLE) AS naive_revenue_at_risk
        FROM newest LEFT JOIN cust_support USING (customer_id)
        WHERE subscription_status = 'Active' AND (COALESCE(m_sat, 5) <= 2.5 OR COALESCE(open_cases, 0) >= 2)"""),
    "q18_overall_churn_rate": sql(f"SELECT {share(GONE, 'COUNT(*)')} AS overall_churn_rate_pct FROM subscriptions"),
    "q19_monthly_churn_rate": sql(f"""SELECT month, COUNT(*) AS cancellations,
        {share('COUNT(*)', '(SELECT COUNT(*) FROM subscriptions b WHERE ' + MONTH('b.start_date') + ' <= g.month)', 3)}
          AS approx_monthly_churn_rate_pct
        FROM (SELECT {MONTH('cancellation_date')} AS month FROM subscriptions WHERE subscription_status = 'Cancelled') g
        GROUP BY month"""),
    "q20_churn_by_plan": _churn("plan_name", "subscriptions JOIN plans USING (plan_id)"),
    "q21_churn_by_billing": _churn("billing_cycle", "subscriptions"),
    "q22_churn_by_region": _churn("region", SUBS_WITH_CUSTOMER),
    "q23_churn_by_channel": _churn("acquisition_channel", SUBS_WITH_CUSTOMER),
    "q24_churn_by_tenure": _churn(_cases(f"date_diff('day', start_date, COALESCE(end_date, {AS_OF}))", (90, 180, 365),
        ('1 - 0-3 months', '2 - 3-6 months', '3 - 6-12 months', '4 - 12+ months')) + " AS tenure_bucket", "subscriptions"),
    "q25_churn_by_age": _churn(_cases("age", (25, 35, 45, 60),
        ('1 - Under 25', '2 - 25-34', '3 - 35-44', '4 - 45-59', '5 - 60+')) + " AS age_group", SUBS_WITH_CUSTOMER),
    "q26_churn_by_engagement": _churn(_cases("tile", (2, 3),
        ('1 - Low engagement', '2 - Medium engagement', '3 - High engagement')) + " AS engagement_level",
        f"({_tile('cust_usage', 'm_sessions', 3)}) u JOIN newest USING (customer_id)", "customers"),
    "q27_churn_by_satisfaction": _churn(_cases("m_sat", (2, 3, 4),
        ('1 - Very Low (<2)', '2 - Low (2-3)', '3 - Medium (3-4)', '4 - High (4-5)')) + " AS satisfaction_band",
        "cust_support JOIN newest USING (customer_id)", "customers"),
    "q28_churn_by_tickets": _churn(_cases("COALESCE(tickets, 0)", (1, 3, 5),
        ('1 - No tickets', '2 - 1-2 tickets', '3 - 3-4 tickets', '4 - 5+ tickets')) + " AS ticket_volume_band",
        "newest LEFT JOIN cust_support USING (customer_id)", "customers"),
    "q29_sessions_by_status": sql(f"""SELECT subscription_status, {rnd('AVG(m_sessions)')} AS avg_sessions_per_customer
        FROM newest JOIN cust_usage USING (customer_id) GROUP BY 1"""),
    "q30_minutes_by_status": sql(f"""SELECT subscription_status, {rnd('AVG(m_minutes)')} AS avg_session_minutes
        FROM newest JOIN cust_usage USING (customer_id) GROUP BY 1"""),
    "q31_features_by_status": sql(f"""SELECT subscription_status, {rnd('AVG(m_features)')} AS avg_feature_usage
        FROM newest JOIN cust_usage USING (customer_id) GROUP BY 1"""),
    "q32_tickets_by_status": sql(f"""SELECT subscription_status, {rnd('AVG(COALESCE(tickets, 0))')} AS avg_tickets,
        {rnd('AVG(m_sat)')} AS avg_satisfaction FROM newest LEFT JOIN cust_support USING (customer_id) GROUP BY 1"""),
    "q33_declining_engagement": sql("SELECT COUNT(*) AS declining_engagement_customers FROM falling", falling=FALLING),
    "q34_high_value_declining": sql("""SELECT COUNT(*) AS high_value_declining_customers,
        CAST(SUM(revenue) AS DOUBLE) AS revenue_represented FROM tiles JOIN falling USING (customer_id) WHERE tile = 4""",
        falling=FALLING, tiles=REV_TILE),
    "q35_retention_by_cohort": sql(f"""SELECT {MONTH('born')} AS cohort_month, COUNT(*) AS cohort_size,
        COUNT(*) FILTER (WHERE subscription_status = 'Active') AS still_active,
        {share("COUNT(*) FILTER (WHERE subscription_status = 'Active')", 'COUNT(*)')} AS retention_rate_pct
        FROM lives JOIN newest USING (customer_id) GROUP BY 1""", lives=FIRST),
    "q36_cohort_milestones": sql(
        f"SELECT {MONTH('born')} AS cohort_month, COUNT(*) AS cohort_size, "
        + ", ".join(f"{share(_kept(d), 'COUNT(*)', 1)} AS m{m}_pct" for m, d in
                    ((0, 0), (1, 30), (2, 60), (3, 90), (6, 180), (12, 365)))
        + " FROM lives GROUP BY 1", lives=FIRST),
    "q37_clv": sql(f"""SELECT {rnd('CAST(SUM(revenue) AS DOUBLE) / COUNT(*)')} AS avg_clv,
        CAST(MIN(revenue) AS DOUBLE) AS min_clv, CAST(MAX(revenue) AS DOUBLE) AS max_clv FROM cust_revenue"""),
    "q38_repeat_rate": sql(f"""SELECT COUNT(*) AS total_customers, COUNT(*) FILTER (WHERE n > 1) AS repeat_customers,
        {share('COUNT(*) FILTER (WHERE n > 1)', 'COUNT(*)')} AS repeat_subscription_rate_pct
        FROM (SELECT customer_id, COUNT(*) AS n FROM subscriptions GROUP BY 1) x"""),
    "q39_avg_tenure_by_status": sql(f"""SELECT subscription_status,
        {rnd(f"AVG(date_diff('day', start_date, COALESCE(end_date, {AS_OF})))", 1)} AS avg_tenure_days FROM newest GROUP BY 1"""),
    "q40_top_decile_revenue": sql(f"""SELECT COUNT(*) AS top_decile_customers, CAST(SUM(revenue) AS DOUBLE) AS revenue_from_top_decile,
        {share('SUM(revenue)', '(SELECT SUM(revenue) FROM cust_revenue)')} AS pct_of_total_revenue
        FROM tiles WHERE tile = 1""", tiles=_tile("cust_revenue", "revenue", 10, "DESC")),
    "q41_high_value_at_risk": sql("""SELECT COUNT(*) AS high_value_at_risk_customers, CAST(SUM(revenue) AS DOUBLE) AS revenue_at_risk
        FROM tiles JOIN newest USING (customer_id) LEFT JOIN cust_support USING (customer_id)
        WHERE tile = 4 AND subscription_status = 'Active' AND (COALESCE(m_sat, 5) <= 3 OR COALESCE(open_cases, 0) >= 1)""",
        tiles=REV_TILE),
    "q42_high_ticket_customers": sql("""SELECT COUNT(*) AS high_ticket_customers, MIN(tickets) AS min_tickets_in_group
        FROM tiles WHERE tile = 1""", tiles=_tile("cust_support", "tickets", 10, "DESC")),
    "q43_high_revenue_low_engagement": sql("""SELECT COUNT(*) AS high_revenue_low_engagement_customers,
        CAST(SUM(revenue) AS DOUBLE) AS revenue_represented
        FROM tiles r JOIN usage_tiles u USING (customer_id) WHERE r.tile = 4 AND u.tile = 1""",
        tiles=REV_TILE, usage_tiles=_tile("cust_usage", "m_sessions", 3)),
    "q44_risk_revenue_by_plan": _risk("plan_name", "JOIN plans USING (plan_id)"),
    "q45_risk_revenue_by_region": _risk("region", "JOIN customers USING (customer_id)"),
    "q46_risk_revenue_by_channel": _risk("acquisition_channel", "JOIN customers USING (customer_id)"),
    "q47_retention_worklist": sql(f"""SELECT customer_id, CAST(revenue AS DOUBLE) AS total_revenue,
        {rnd('COALESCE(m_sat, 5)')} AS avg_satisfaction, COALESCE(open_cases, 0) AS unresolved_tickets
        FROM newest JOIN cust_revenue USING (customer_id) LEFT JOIN cust_support USING (customer_id)
        WHERE subscription_status = 'Active'
        ORDER BY COALESCE(open_cases, 0) * 1000 + (5 - COALESCE(m_sat, 5)) * 500 + CAST(revenue AS DOUBLE) / 100.0::DOUBLE DESC,
                 customer_id LIMIT 25"""),
    "v01_customer_360": sql(f"""SELECT c.customer_id, c.signup_date, c.age, c.gender, c.country, c.region, c.acquisition_channel,
        n.plan_id, plan_name, n.billing_cycle, CAST(n.monthly_price AS DOUBLE) AS monthly_price, n.discount_percentage,
        n.subscription_status, n.cancellation_date, n.cancellation_reason,
        CAST(COALESCE(revenue, 0) AS DOUBLE) AS total_revenue, COALESCE(n_paid, 0) AS total_transactions, last_transaction_date,
        COALESCE(m_sessions, 0) AS avg_sessions, COALESCE(m_minutes, 0) AS avg_session_minutes,
        COALESCE(m_features, 0) AS avg_feature_usage, last_activity_date, COALESCE(tickets, 0) AS total_tickets,
        m_sat AS avg_satisfaction, COALESCE(open_cases, 0) AS unresolved_tickets,
        CAST(COALESCE(n.subscription_status, '') = 'Cancelled' AS INTEGER) AS is_churned,
        CAST(date_diff('day', c.signup_date, {AS_OF}) // 30 AS INTEGER) AS tenure_months
        FROM customers c LEFT JOIN newest n USING (customer_id) LEFT JOIN plans p ON p.plan_id = n.plan_id
        LEFT JOIN cust_revenue USING (customer_id) LEFT JOIN cust_usage USING (customer_id) LEFT JOIN cust_support USING (customer_id)
        LEFT JOIN (SELECT customer_id, COUNT(*) AS n_paid FROM paid GROUP BY 1) k USING (customer_id)
        LEFT JOIN (SELECT customer_id, MAX(transaction_date) AS last_transaction_date FROM transactions GROUP BY 1) l USING (customer_id)
        LEFT JOIN (SELECT customer_id, MAX(activity_date) AS last_activity_date FROM customer_activity GROUP BY 1) a USING (customer_id)"""),
    "c01_cohort_long": sql(COHORT_LONG, lives=FIRST),
    "c02_cohort_matrix": sql(
        "SELECT cohort_month, " + ", ".join(f"MAX(retention_pct) FILTER (WHERE milestone = 'M{m}') AS \"M{m}\"" for m in
                                            (0, 1, 2, 3, 6, 12)) + " FROM long_form GROUP BY 1",
        lives=FIRST, long_form=COHORT_LONG),
    "c03_cohort_trend": sql(f"""SELECT {rnd('AVG(retention_pct) FILTER (WHERE h)', 1)} AS early_avg_m3,
        {rnd('AVG(retention_pct) FILTER (WHERE NOT h)', 1)} AS late_avg_m3,
        CASE SIGN(AVG(retention_pct) FILTER (WHERE NOT h) - AVG(retention_pct) FILTER (WHERE h))
             WHEN 1 THEN 'improving' WHEN -1 THEN 'declining' WHEN 0 THEN 'flat' END AS trend
        FROM (SELECT retention_pct, ROW_NUMBER() OVER (ORDER BY cohort_month) <= COUNT(*) OVER () // 2 AS h
              FROM long_form WHERE milestone = 'M3') x""", lives=FIRST, long_form=COHORT_LONG),
}
