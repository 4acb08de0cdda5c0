"""Key -> plan for every report, grouped by the tables it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from holdfast.plans import (
    association, behaviour, churn, churn_model, cleaning, cohorts, customer_view, customers, dashboards, exploration, features,
    kpi, model_checks, quality, records, revenue, rfm, value_at_risk,
)
from holdfast.plans.cleaning import audit_of
from holdfast.sources.tables import Tables

Plan = Callable[[Tables], DataFrame]

BUSINESS: dict[str, Plan] = {
    "q01_total_customers": customers.total_customers,
    "q02_active_customers": customers.active_customers,
    "q03_churned_customers": customers.churned_customers,
    "q04_new_customers_by_month": customers.new_customers_by_month,
    "q05_customers_by_region": customers.customers_by_region,
    "q06_customers_by_channel": customers.customers_by_channel,
    "q07_customers_by_plan": customers.customers_by_plan,
    "q08_customers_by_tenure": customers.customers_by_tenure,
    "q09_total_revenue": revenue.total_revenue,
    "q10_monthly_revenue": revenue.monthly_revenue,
    "q11_mom_growth": revenue.mom_growth,
    "q12_revenue_by_plan": revenue.revenue_by_plan,
    "q13_revenue_by_region": revenue.revenue_by_region,
    "q14_revenue_by_channel": revenue.revenue_by_channel,
    "q15_arpu": revenue.arpu,
    "q16_revenue_lost": revenue.revenue_lost,
    "q17_naive_revenue_at_risk": revenue.naive_revenue_at_risk,
    "q18_overall_churn_rate": churn.overall_churn_rate,
    "q19_monthly_churn_rate": churn.monthly_churn_rate,
    "q20_churn_by_plan": churn.churn_by_plan,
    "q21_churn_by_billing": churn.churn_by_billing,
    "q22_churn_by_region": churn.churn_by_region,
    "q23_churn_by_channel": churn.churn_by_channel,
    "q24_churn_by_tenure": churn.churn_by_tenure,
    "q25_churn_by_age": churn.churn_by_age,
    "q26_churn_by_engagement": churn.churn_by_engagement,
    "q27_churn_by_satisfaction": churn.churn_by_satisfaction,
    "q28_churn_by_tickets": churn.churn_by_tickets,
    "q29_sessions_by_status": behaviour.sessions_by_status,
    "q30_minutes_by_status": behaviour.minutes_by_status,
    "q31_features_by_status": behaviour.features_by_status,
    "q32_tickets_by_status": behaviour.tickets_by_status,
    "q33_declining_engagement": behaviour.declining_engagement,
    "q34_high_value_declining": behaviour.high_value_declining,
    "q35_retention_by_cohort": cohorts.retention_by_cohort,
    "q36_cohort_milestones": cohorts.cohort_milestones,
    "q37_clv": cohorts.clv,
    "q38_repeat_rate": cohorts.repeat_rate,
    "q39_avg_tenure_by_status": cohorts.avg_tenure_by_status,
    "q40_top_decile_revenue": value_at_risk.top_decile_revenue,
    "q41_high_value_at_risk": value_at_risk.high_value_at_risk,
    "q42_high_ticket_customers": value_at_risk.high_ticket_customers,
    "q43_high_revenue_low_engagement": value_at_risk.high_revenue_low_engagement,
    "q44_risk_revenue_by_plan": value_at_risk.risk_revenue_by_plan,
    "q45_risk_revenue_by_region": value_at_risk.risk_revenue_by_region,
    "q46_risk_revenue_by_channel": value_at_risk.risk_revenue_by_channel,
    "q47_retention_worklist": value_at_risk.retention_worklist,
    "e01_age_histogram": exploration.age_histogram,
    "e02_customer_growth": exploration.customer_growth,
    "e03_monthly_revenue_filled": exploration.monthly_revenue_filled,
    "e04_plan_counts": exploration.plan_counts,
    "e05_channel_counts": exploration.channel_counts,
    "e06_churn_by_channel_cust": exploration.churn_by_channel,
    "e07_churn_by_plan_cust": exploration.churn_by_plan,
    "e08_churn_by_billing_cust": exploration.churn_by_billing,
    "e09_monthly_cancellations": exploration.monthly_cancellations,
    "e10_sessions_density": exploration.sessions_density,
    "e11_churn_by_ticket_band": exploration.churn_by_ticket_band,
    "e12_churn_by_sat_band": exploration.churn_by_sat_band,
    "e13_tenure_at_churn": exploration.tenure_at_churn,
    "e14_revenue_by_region": exploration.revenue_by_region,
    "e15_churn_by_discount_band": exploration.churn_by_discount_band,
    "e16_feature_usage_box": exploration.feature_usage_box,
    "e17_churn_by_age_band": exploration.churn_by_age_band,
    "e18_headline": exploration.headline,
    "r01_rfm_base": rfm.rfm_base_report,
    "r02_rfm_scores": rfm.rfm_scores,
    "r03_rfm_segments": rfm.rfm_segments,
    "r04_segment_summary": rfm.segment_summary,
    "s00_stat_base": association.stat_base,
    "s01_welch_t": association.welch_report,
    "s02_chi_square": association.chi_square_report,
    "s03_point_biserial": association.point_biserial_report,
    "s04_test_report": association.association_report,
    "f01_observation_window": features.observation_window,
    "f02_tenure": features.tenure_report,
    "f03_engagement": features.engagement_report,
    "f04_engagement_trend": features.trend_report,
    "f05_support": features.support_report,
    "f06_revenue": features.revenue_report,
    "f07_feature_table": features.features,
    "f08_feature_profile": features.feature_profile,
    "k01_total_customers": kpi.measure("total_customers"),
    "k03_churned_customers_by_plan": kpi.measure("churned_customers", "plan_name"),
    "k05_churn_rate_by_plan": kpi.measure("churn_rate", "plan_name"),
    "k05_churn_rate_by_month": kpi.measure("churn_rate", "month"),
    "k06_retention_rate_by_plan": kpi.measure("retention_rate", "plan_name"),
    "k13_arpu_by_plan": kpi.measure("arpu", "plan_name"),
    "k14_revenue_lost_by_cancellation_month": kpi.measure("revenue_lost", "month", subscription_date="cancellation_date"),
    "k02_active_customers": kpi.measure("active_customers"),
    "k03_churned_customers": kpi.measure("churned_customers"),
    "k04_new_customers": kpi.measure("new_customers", "month"),
    "k05_churn_rate": kpi.measure("churn_rate"),
    "k05_churn_rate_by_region": kpi.measure("churn_rate", "region"),
    "k06_retention_rate": kpi.measure("retention_rate"),
    "k07_customer_growth": kpi.customer_growth,
    "k08_avg_tenure": kpi.measure("avg_tenure_days"),
    "k09_total_revenue": kpi.measure("total_revenue"),
    "k09_total_revenue_by_plan_region": kpi.measure("total_revenue", "plan_name", "region"),
    "k10_monthly_revenue": kpi.monthly_revenue,
    "k11_mrr": kpi.measure("mrr"),
    "k11_mrr_by_plan": kpi.measure("mrr", "plan_name"),
    "k12_revenue_growth": kpi.revenue_growth,
    "k13_arpu": kpi.measure("arpu"),
    "k13_arpu_by_segment": kpi.measure("arpu", "segment"),
    "k14_revenue_lost": kpi.measure("revenue_lost"),
    "k16_clv": kpi.measure("clv"),
    "k17_avg_sessions": kpi.measure("avg_sessions"),
    "k18_avg_duration": kpi.measure("avg_session_duration"),
    "k19_feature_usage": kpi.measure("feature_usage"),
    "k20_support_tickets": kpi.measure("support_tickets"),
    "k21_avg_satisfaction": kpi.measure("avg_satisfaction"),
    "k21_avg_satisfaction_by_channel": kpi.measure("avg_satisfaction", "acquisition_channel"),
    "k26_date_dimension": kpi.date_dimension,
    "k27_headline_snapshot": kpi.headline_snapshot,
    "d01_cumulative_customers": dashboards.cumulative_customers,
    "d02_churn_combo": dashboards.churn_combo,
    "d03_retention_trend": dashboards.retention_trend,
    "d04_mrr_trend": dashboards.mrr_trend,
    "d05_revenue_lost_trend": dashboards.revenue_lost_trend,
    "d07_segment_feed": dashboards.segment_feed,
    "d07_tenure_histogram": dashboards.tenure_histogram,
    "d08_churn_gaps": dashboards.churn_gaps,
    "d08_top_finding": dashboards.top_finding,
    "v01_customer_360": customer_view.customer_360,
    "c01_cohort_long": cohorts.cohort_long,
    "c02_cohort_matrix": cohorts.cohort_matrix,
    "c03_cohort_trend": cohorts.cohort_trend,
}

# what needs the split feature table or a fit: these share one bundle of tables
SCORED: dict[str, Plan] = {
    "m01_split": churn_model.split_report,
    "m02_preprocess": churn_model.preprocess_report,
    "m02_one_hot": churn_model.one_hot_report,
    "m03_class_weight": churn_model.class_weight_report,
    "m04_logistic": churn_model.logistic_report,
    "m04_coefficients": model_checks.coefficients,
    "m04_optimality": model_checks.optimality_check,
    "m05_random_forest": churn_model.forest_report,
    "m05_forest_nodes": model_checks.forest_nodes,
    "m05_forest_walk": model_checks.forest_walk_check,
    "m06_metrics": churn_model.metrics_report,
    "m07_confusion": churn_model.confusion_report,
    "m07_class_report": churn_model.class_report_table,
    "m08_roc_curve": churn_model.roc_report,
    "m09_feature_importance": churn_model.importance_report,
    "m09_top_features": churn_model.top_importance_report,
    "m09_importance_check": model_checks.importance_check,
    "m10_select_best": churn_model.best_model_report,
    "m11_score_customers": churn_model.scores_report,
    "m12_risk_distribution": churn_model.risk_distribution,
    "m13_revenue_at_risk": churn_model.revenue_at_risk_report,
    "m13_revenue_at_risk_total": churn_model.revenue_at_risk_total,
    "m14_retention_priority": churn_model.priority_report,
    "m15_priority_worklist": churn_model.worklist_report,
    "m15_worklist_top10": churn_model.worklist_top,
    "m16_run_summary": churn_model.run_summary,
    "m16_summary_rows": records.summary_rows,
    "k15_revenue_at_risk": kpi.measure("revenue_at_risk"),
    "k22_high_risk_customers": kpi.measure("high_risk_customers"),
    "k23_high_value_at_risk": kpi.measure("high_value_at_risk"),
    "k24_avg_churn_probability": kpi.measure("avg_churn_probability"),
    "k25_dynamic_risk_level": kpi.dynamic_risk_level,
    "k25_risk_level_sweep": kpi.risk_level_sweep,
    "k27_headline_json": kpi.headline_json,
    "k27_json_rows": records.snapshot_rows,
    "d06_risk_by_plan_region": dashboards.risk_by_plan_region,
    "d09_worklist_filtered": dashboards.worklist_filtered,
    "dq13_derived_grain": dashboards.derived_grain,
}


def _fixed(plan: Plan) -> Plan:
    """The plan over two stated formulas in place of the trained models."""
    return lambda t: plan(t.once("fixed", lambda: churn_model.with_fixed_formula(t)))


# what needs no score or the trained models themselves, and records whose rows have a twin
_NO_TWIN = (
    "m01_split", "m02_preprocess", "m02_one_hot", "m03_class_weight", "m04_coefficients", "m04_optimality", "m05_forest_nodes",
    "m05_forest_walk", "m09_feature_importance", "m09_top_features", "m09_importance_check", "m16_run_summary", "k27_headline_json",
)
# everything that follows from a score
SCORED.update({f"{key}_fixed": _fixed(plan) for key, plan in list(SCORED.items()) if key not in _NO_TWIN})

# plans over the tables as they arrive, defects included
RAW: dict[str, Plan] = {
    "cl01_dedupe_customers": audit_of("customers", "duplicate_customers"),
    "cl02_title_country": audit_of("customers", "country_case"),
    "cl03_title_gender": audit_of("customers", "gender_case"),
    "cl04_invalid_age": audit_of("customers", "invalid_age"),
    "cl05_impute_age": audit_of("customers", "missing_age"),
    "cl06_fill_customer_labels": audit_of("customers", "missing_gender", "missing_country", "missing_referral"),
    "cl07_std_status": audit_of("subscriptions", "status_case"),
    "cl08_backfill_cancel_date": audit_of("subscriptions", "cancelled_without_date"),
    "cl09_fill_discount": audit_of("subscriptions", "missing_discount"),
    "cl10_reset_bad_dates": audit_of("subscriptions", "end_before_start"),
    "cl11_dedupe_txn": audit_of("transactions", "duplicate_transactions"),
    "cl12_orphan_txn_sub": audit_of("transactions", "orphan_subscription"),
    "cl13_abs_negative_charge": audit_of("transactions", "negative_charge"),
    "cl14_fill_payment_status": audit_of("transactions", "missing_payment_status"),
    "cl15_orphan_txn_cust": audit_of("transactions", "orphan_customer"),
    "cl16_impute_minutes": audit_of("customer_activity", "missing_minutes"),
    "cl17_fill_feature_usage": audit_of("customer_activity", "missing_features"),
    "cl18_orphan_activity": audit_of("customer_activity", "orphan_activity"),
    "cl19_std_issue_type": audit_of("support_tickets", "issue_case"),
    "cl20_impute_satisfaction": audit_of("support_tickets", "missing_satisfaction"),
    "cl21_impute_resolution": audit_of("support_tickets", "missing_resolution"),
    "cl22_orphan_interactions": audit_of("customer_campaign_interactions", "orphan_interactions"),
    "cl23_quality_report": lambda t: cleaning.quality_report(t).select("issue", "affected", "total", "pct"),
    "cl23_quality_totals": cleaning.quality_totals,
    "cl24_row_deltas": cleaning.row_deltas,
    "cl25_raw_defect_profile": cleaning.raw_defect_profile,
    "cl25_raw_status_counts": cleaning.raw_status_counts,
    "cl26_post_clean_checks": cleaning.post_clean_checks,
    "clean_customers": cleaning.cleaned("customers"),
    "clean_subscriptions": cleaning.cleaned("subscriptions"),
    "clean_transactions": cleaning.cleaned("transactions"),
    "clean_activity": cleaning.cleaned("customer_activity"),
    "clean_tickets": cleaning.cleaned("support_tickets"),
    "clean_interactions": cleaning.cleaned("customer_campaign_interactions"),
    "dq01_row_counts": quality.row_counts,
    "dq02_duplicate_customers": quality.duplicate_customers,
    "dq03_orphan_subscriptions": quality.orphan_subscriptions,
    "dq04_orphan_transactions": quality.orphan_transactions,
    "dq05_cancelled_without_date": quality.cancelled_without_date,
    "dq06_end_before_start": quality.end_before_start,
    "dq07_negative_charges": quality.negative_charges,
    "dq08_age_bounds": quality.age_bounds,
    "dq09_null_audit": quality.null_audit,
    "dq10a_distinct_status": quality.distinct_values("subscriptions", "subscription_status"),
    "dq10b_distinct_billing": quality.distinct_values("subscriptions", "billing_cycle"),
    "dq10c_distinct_issue_type": quality.distinct_values("support_tickets", "issue_type"),
    "dq11_check_constraints": quality.check_constraints,
    "dq12_foreign_keys": quality.foreign_keys,
    "dq13_grain": quality.dimension_grain,
}
