"""Expected reports on a churn score, with two stated formulas in place of the trained models."""

from __future__ import annotations

from oracle.base import CTES, rnd, sql
from oracle import analysis, measures

LOGISTIC, FOREST = "Logistic Regression", "Random Forest"


def _squash(z: str) -> str:
    return rnd(f"(1 + ({z}) / (1 + ABS({z}))) / 2", 4)


def _part(a: str, b: str) -> str:
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0)"


CTES.update({
    "formula_rows": f"""SELECT *, {_squash("(recency_days - 150) / 60 + unresolved_tickets - tenure_days / 2000")} AS p1,
      {_squash("(recency_days - 200) / 40 - avg_sessions / 10 + total_tickets / 5")} AS p2 FROM split_rows""",
    "guesses": f"""SELECT *, CAST(p >= 0.5 AS INTEGER) AS guess FROM (
      SELECT '{LOGISTIC}' AS model, churn, p1 AS p FROM formula_rows WHERE split = 'test'
      UNION ALL SELECT '{FOREST}', churn, p2 FROM formula_rows WHERE split = 'test') x""",
    "curve": """SELECT model, p, pos, neg, SUM(pos) OVER down AS cum_pos, SUM(neg) OVER down AS cum_neg,
      SUM(pos) OVER (PARTITION BY model) AS all_pos, SUM(neg) OVER (PARTITION BY model) AS all_neg
      FROM (SELECT model, p, COUNT(*) FILTER (WHERE churn = 1) AS pos, COUNT(*) FILTER (WHERE churn = 0) AS neg
            FROM guesses GROUP BY ALL) x WINDOW down AS (PARTITION BY model ORDER BY p DESC)""",
    "judged": f"""SELECT model, {rnd(_part("COUNT(*) FILTER (WHERE churn = guess)", "COUNT(*)"), 4)} AS accuracy,
      {rnd(_part("SUM(churn * guess)", "SUM(guess)"), 4)} AS precision, {rnd(_part("SUM(churn * guess)", "SUM(churn)"), 4)} AS recall,
      {rnd(_part("2 * SUM(churn * guess)", "SUM(churn) + SUM(guess)"), 4)} AS f1_score, ANY_VALUE(roc_auc) AS roc_auc
      FROM guesses JOIN (SELECT model, {rnd("SUM(neg * (cum_pos - pos / 2) / (CAST(all_pos AS DOUBLE) * all_neg))", 4)} AS roc_auc
                         FROM curve GROUP BY 1) a USING (model) GROUP BY 1""",
    "chosen": "SELECT arg_max(model, (roc_auc, model)) AS model FROM judged",
    "risky": f"""SELECT *, CASE WHEN churn_probability >= 0.7 THEN 'High' WHEN churn_probability >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk_level
      FROM (SELECT f.*, CASE WHEN (SELECT model FROM chosen) = '{FOREST}' THEN p2 ELSE p1 END AS churn_probability FROM formula_rows f) x""",
    "valued": f"""SELECT *, {rnd("annualized_value * churn_probability")} AS revenue_at_risk FROM (
      SELECT *, CASE billing_cycle WHEN 'Monthly' THEN monthly_price * 12 ELSE monthly_price END AS annualized_value
      FROM risky WHERE churn = 0) x""",
    "listed": """SELECT customer_id, plan_name, annualized_value AS annualized_revenue, churn_probability, risk_level,
      CASE WHEN churn_probability >= 0.7 AND annualized_value >= typical THEN 'Priority 1 - High Risk / High Value'
           WHEN churn_probability >= 0.7 THEN 'Priority 2 - High Risk / Medium-Low Value'
           WHEN churn_probability >= 0.4 AND annualized_value >= typical THEN 'Priority 3 - Medium Risk / High Value'
           ELSE 'Priority 4 - Low Risk' END AS retention_priority, revenue_at_risk
      FROM valued, (SELECT quantile_cont(annualized_value, 0.5) AS typical FROM valued) m""",
})
CELLS = """SELECT m.model, v.churn, w.prediction, (SELECT COUNT(*) FROM guesses g WHERE g.model = m.model AND g.churn = v.churn
    AND g.guess = w.prediction) AS n FROM (SELECT DISTINCT model FROM guesses) m, (VALUES (0), (1)) v(churn), (VALUES (0), (1)) w(prediction)"""
PAIRS = """SELECT CAST(h AS DOUBLE) / 100 AS high, CAST(m AS DOUBLE) / 100 AS medium
    FROM range(50, 91, 5) a(h), range(20, 61, 5) b(m)"""

# names of the models' inputs: the numbers, then every category value of the training rows
INPUTS = " UNION ALL ".join([
    *[f"SELECT '{c}' AS feature" for c in measures.NUMERIC],
    *[f"SELECT DISTINCT '{c}_' || {c} FROM train_rows WHERE {c} IS NOT NULL" for c in ("acquisition_channel", "plan_name", "billing_cycle")]])


def _cells(source: str, section: str, names, item: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {item + ' || ' if item else ''}'{'.' if item else ''}{n}' AS item, CAST({n} AS DOUBLE) AS value, "
        f"CAST(NULL AS VARCHAR) AS label FROM {source}" for n in names)


METRICS = ("accuracy", "precision", "recall", "f1_score", "roc_auc")
SUMMARY_ROWS = f"""SELECT 'best_model' AS section, 'model' AS item, CAST(NULL AS DOUBLE) AS value, model AS label FROM chosen
    UNION ALL SELECT 'risk', 'total_revenue_at_risk', {rnd('SUM(revenue_at_risk)')}, NULL FROM valued
    UNION ALL SELECT 'risk', LOWER(level) || '_risk_customers', CAST((SELECT COUNT(*) FROM risky WHERE risk_level = level) AS DOUBLE), NULL
      FROM (VALUES ('High'), ('Medium'), ('Low')) v(level)
    UNION ALL SELECT 'threshold', name, bound, NULL FROM (VALUES ('high', 0.7::DOUBLE), ('medium', 0.4::DOUBLE)) v(name, bound)
    UNION ALL {_cells('judged', 'comparison', METRICS, 'model')}"""
SNAPSHOT_ROWS = " UNION ALL ".join([
    _cells(f"({measures.QUERIES['k27_headline_snapshot']}) a", "headline", (
        "total_customers", "churned_customers", "active_customers", "total_subscriptions", "total_transactions", "overall_churn_rate_pct",
        "churn_monthly_pct", "churn_annual_pct", "total_revenue", "arpu", "annualized_revenue_lost_to_churn")),
    f"SELECT 'churn_by_plan', plan_name, churn_rate_pct, NULL FROM ({analysis.QUERIES['e07_churn_by_plan_cust']}) b",
    _cells(f"({analysis.QUERIES['r04_segment_summary']}) c", "segments", ("customers", "total_revenue", "churn_rate", "pct_of_customers", "pct_of_revenue"), "segment"),
    SUMMARY_ROWS,
])

QUERIES: dict[str, str] = {
    # the checks of the trained models: nothing may differ
    "m04_optimality": sql("SELECT feature, TRUE AS flat FROM inputs UNION ALL SELECT 'intercept', TRUE", inputs=INPUTS),
    "m05_forest_walk": sql("SELECT COUNT(*) AS rows, 0::BIGINT AS differing FROM split_rows WHERE split = 'test'"),
    "m09_importance_check": sql("SELECT feature, TRUE AS agrees FROM inputs", inputs=INPUTS),
    "m16_summary_rows_fixed": sql(SUMMARY_ROWS),
    "k27_json_rows_fixed": sql(SNAPSHOT_ROWS),
    "m02_one_hot": sql("""SELECT feature, value, n, CAST(ROW_NUMBER() OVER (PARTITION BY feature ORDER BY n DESC, value) - 1 AS INTEGER) AS position FROM (
        SELECT 'acquisition_channel' AS feature, acquisition_channel AS value, COUNT(*) AS n FROM train_rows GROUP BY ALL
        UNION ALL SELECT 'plan_name', plan_name, COUNT(*) FROM train_rows GROUP BY ALL
        UNION ALL SELECT 'billing_cycle', billing_cycle, COUNT(*) FROM train_rows GROUP BY ALL) x WHERE value IS NOT NULL"""),
    "m04_logistic_fixed": sql(f"SELECT * FROM judged WHERE model = '{LOGISTIC}'"),
    "m05_random_forest_fixed": sql(f"SELECT * FROM judged WHERE model = '{FOREST}'"),
    "m06_metrics_fixed": sql("SELECT * FROM judged"),
    "m07_confusion_fixed": sql("SELECT * FROM cells", cells=CELLS),
    "m07_class_report_fixed": sql(f"""SELECT model, CASE churn WHEN 1 THEN 'Churned' ELSE 'Retained' END AS class,
        {rnd(_part('hit', 'said'), 4)} AS precision, {rnd(_part('hit', 'support'), 4)} AS recall,
        {rnd(_part('2 * hit', 'said + support'), 4)} AS f1_score, CAST(support AS BIGINT) AS support,
        {rnd(_part('support', 'SUM(support) OVER (PARTITION BY model)'), 4)} AS share
        FROM (SELECT a.model, a.churn, a.n AS hit, (SELECT SUM(n) FROM cells b WHERE b.model = a.model AND b.churn = a.churn) AS support,
                     (SELECT SUM(n) FROM cells b WHERE b.model = a.model AND b.prediction = a.churn) AS said
              FROM cells a WHERE a.churn = a.prediction) x""", cells=CELLS),
    "m08_roc_curve_fixed": sql("""SELECT model, p AS threshold, CAST(cum_neg AS DOUBLE) / all_neg AS fpr, CAST(cum_pos AS DOUBLE) / all_pos AS tpr FROM curve
        UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM curve"""),
    "m10_select_best_fixed": sql("SELECT model FROM chosen"),
    "m11_score_customers_fixed": sql("SELECT customer_id, churn_probability, risk_level FROM risky"),
    "m12_risk_distribution_fixed": sql("SELECT risk_level, COUNT(*) AS customers FROM risky GROUP BY 1"),
    "m13_revenue_at_risk_fixed": sql("SELECT customer_id, annualized_value, churn_probability, revenue_at_risk FROM valued"),
    "m13_revenue_at_risk_total_fixed": sql(f"SELECT COUNT(*) AS active_customers, {rnd('SUM(revenue_at_risk)')} AS total_revenue_at_risk FROM valued"),
    "m14_retention_priority_fixed": sql("SELECT retention_priority, COUNT(*) AS customers FROM listed GROUP BY 1"),
    "m15_priority_worklist_fixed": sql("SELECT * FROM listed"),
    "m15_worklist_top10_fixed": sql("SELECT * FROM listed ORDER BY churn_probability DESC, customer_id LIMIT 10"),
    "k15_revenue_at_risk_fixed": sql(f"SELECT {rnd('SUM(annualized_revenue * churn_probability)')} AS revenue_at_risk FROM listed"),
    "k22_high_risk_customers_fixed": sql("SELECT COUNT(*) AS high_risk_customers FROM risky WHERE risk_level = 'High'"),
    "k23_high_value_at_risk_fixed": sql("SELECT COUNT(*) AS high_value_at_risk FROM listed WHERE retention_priority LIKE 'Priority 1%'"),
    "k24_avg_churn_probability_fixed": sql(f"SELECT {rnd('AVG(churn_probability)', 6)} AS avg_churn_probability FROM risky"),
    "k25_dynamic_risk_level_fixed": sql("SELECT risk_level, COUNT(*) AS customers FROM risky GROUP BY 1"),
    "k25_risk_level_sweep_fixed": sql("""SELECT high, medium, risk_level, COUNT(n) AS customers FROM (
        SELECT high, medium, level AS risk_level FROM pairs, (VALUES ('High'), ('Medium'), ('Low')) v(level)) a
        LEFT JOIN (SELECT high, medium, CASE WHEN churn_probability >= high THEN 'High' WHEN churn_probability >= medium THEN 'Medium'
                   ELSE 'Low' END AS risk_level, 1 AS n FROM risky, pairs) b USING (high, medium, risk_level) GROUP BY ALL""", pairs=PAIRS),
    "d06_risk_by_plan_region_fixed": sql(f"""SELECT plan_name, region, {rnd('SUM(revenue_at_risk)')} AS revenue_at_risk, COUNT(*) AS customers
        FROM listed JOIN customers USING (customer_id) GROUP BY ALL"""),
    "d09_worklist_filtered_fixed": sql("""SELECT customer_id, plan_name, annualized_revenue, churn_probability, risk_level, retention_priority
        FROM listed WHERE retention_priority LIKE 'Priority 1%'"""),
    "dq13_derived_grain_fixed": sql("""SELECT 'churn_scores' AS relation, COUNT(*) - COUNT(DISTINCT customer_id) AS repeated_keys FROM risky
        UNION ALL SELECT 'segments', COUNT(*) - COUNT(DISTINCT customer_id) FROM rfm_named
        UNION ALL SELECT 'worklist', COUNT(*) - COUNT(DISTINCT customer_id) FROM listed
        UNION ALL SELECT 'worklist_not_active', COUNT(*) FROM listed WHERE customer_id NOT IN
          (SELECT customer_id FROM newest WHERE subscription_status <> 'Cancelled')"""),
}
