"""DuckDB oracle SQL for the BI queries (B1-B18), same names and types as the Spark side.

bills are reduced to one row per visit and met with the visit's provider;
top-k queries rank the whole result and cut it with QUALIFY.
"""

from careops.sources.fixtures import with_fixtures

B = {}

# measures of each provider's bills, from one row per visit
PROVIDERS = """
per_visit AS (
  SELECT visit_id, COUNT(bill_id) AS bills, COUNT(*) AS rows_,
    COUNT(*) FILTER (claim_status = 'Rejected') AS rejected, COUNT(*) FILTER (claim_status = 'Pending') AS pending,
    COALESCE(SUM(billed_amount) FILTER (claim_status = 'Rejected'), 0) AS rejected_sum,
    COALESCE(SUM(billed_amount) FILTER (claim_status = 'Pending'), 0) AS pending_sum,
    SUM(billed_amount) AS billed, SUM(approved_amount) AS approved,
    SUM(payment_days) AS days, COUNT(payment_days) AS dated
  FROM billing GROUP BY visit_id),
owner AS (SELECT visit_id, insurance_provider FROM visits NATURAL JOIN patients),
provider AS (
  SELECT insurance_provider, CAST(SUM(bills) AS BIGINT) AS bills, CAST(SUM(rows_) AS BIGINT) AS rows_,
    CAST(SUM(rejected) AS BIGINT) AS rejected, CAST(SUM(pending) AS BIGINT) AS pending,
    CAST(SUM(rejected_sum) AS DOUBLE) AS rejected_sum, CAST(SUM(pending_sum) AS DOUBLE) AS pending_sum,
    SUM(billed) AS billed, SUM(approved) AS approved,
    CAST(SUM(days) AS DOUBLE) / NULLIF(SUM(dated), 0) AS mean_days, SUM(dated) AS dated
  FROM owner JOIN per_visit USING (visit_id) GROUP BY insurance_provider)"""


def _top(k: int, measure: str, key: str) -> str:
    return f"QUALIFY ROW_NUMBER() OVER (ORDER BY {measure} DESC NULLS LAST, {key} NULLS FIRST) <= {k}"


B["b01_visits_by_department"] = with_fixtures("""
marked AS (SELECT DISTINCT department, COUNT(*) OVER (PARTITION BY department) AS visit_volume FROM visits)""", f"""
SELECT department, visit_volume FROM marked {_top(10, 'visit_volume', 'department')}""")

B["b02_longest_stay_departments"] = with_fixtures("""
sums AS (SELECT department, SUM(length_of_stay_hours) AS hours, COUNT(length_of_stay_hours) AS n
  FROM visits GROUP BY department),
means AS (SELECT department, CAST(ROUND(CAST(hours AS DOUBLE) / NULLIF(n, 0), 2) AS DOUBLE) AS avg_length_of_stay_hours
  FROM sums)""", f"""
SELECT * FROM means {_top(5, 'avg_length_of_stay_hours', 'department')}""")

B["b03_high_risk_share"] = with_fixtures("""
every AS (SELECT department, COUNT(*) AS n FROM visits GROUP BY ALL),
high AS (SELECT department, COUNT(*) AS n FROM visits WHERE risk_score = 'High' GROUP BY ALL)""", """
SELECT every.department, every.n AS total_visits, COALESCE(high.n, 0) AS high_risk_visits,
  CAST(ROUND(100.0 * COALESCE(high.n, 0) / every.n, 2) AS DOUBLE) AS high_risk_percentage
FROM every LEFT JOIN high ON every.department IS NOT DISTINCT FROM high.department""")

B["b04_visits_per_patient_by_city"] = with_fixtures("""
per_patient AS (SELECT patient_id, COUNT(visit_id) AS n FROM visits GROUP BY patient_id),
cities AS (SELECT city, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS total_visits, COUNT(*) AS unique_patients
  FROM patients LEFT JOIN per_patient USING (patient_id) GROUP BY city)""", """
SELECT *, CAST(ROUND(CAST(total_visits AS DOUBLE) / unique_patients, 2) AS DOUBLE) AS avg_visits_per_patient FROM cities""")

B["b05_top_high_risk_doctors"] = with_fixtures("""
handled AS (SELECT doctor_id, CAST(SUM(CAST(risk_score = 'High' AS INT)) AS BIGINT) AS high_risk_visits_handled
  FROM visits GROUP BY doctor_id)""", f"""
SELECT * FROM handled WHERE high_risk_visits_handled > 0 {_top(10, 'high_risk_visits_handled', 'doctor_id')}""")

B["b06_billed_by_provider"] = with_fixtures(PROVIDERS, f"""
SELECT insurance_provider, CAST(billed AS DOUBLE) AS total_billed_amount FROM provider
{_top(10, 'billed', 'insurance_provider')}""")

B["b07_top_rejection_rate"] = with_fixtures(PROVIDERS + """,
rates AS (SELECT insurance_provider, bills AS total_claims, rejected AS rejected_claims,
    CAST(ROUND(100.0 * rejected / NULLIF(bills, 0), 2) AS DOUBLE) AS rejection_rate FROM provider)""", f"""
SELECT * FROM rates {_top(5, 'rejection_rate', 'insurance_provider')}""")

B["b08_payment_delay_by_provider"] = with_fixtures(PROVIDERS, """
SELECT insurance_provider, CAST(ROUND(mean_days, 1) AS DOUBLE) AS avg_payment_delay_days FROM provider WHERE dated > 0""")

B["b09_realization_by_department"] = with_fixtures(PROVIDERS + """,
sums AS (SELECT department, SUM(billed) AS b, SUM(approved) AS a
  FROM per_visit JOIN visits USING (visit_id) GROUP BY department)""", """
SELECT department, CAST(b AS DOUBLE) AS total_billed, CAST(a AS DOUBLE) AS total_approved,
  CAST(ROUND(a / NULLIF(b, 0), 4) AS DOUBLE) AS revenue_realization_ratio FROM sums""")

B["b10_unapproved_high_bills"] = with_fixtures("""
mean AS (SELECT SUM(billed_amount) / COUNT(billed_amount) AS level FROM billing),
high AS (SELECT billing.* FROM billing, mean WHERE COALESCE(approved_amount, 0) = 0 AND billed_amount > level),
placed AS (SELECT visits.visit_id, visit_date, department, billed_amount, approved_amount, claim_status,
    ROW_NUMBER() OVER (ORDER BY billed_amount DESC, visits.visit_id, bill_id) AS place
  FROM high JOIN visits ON visits.visit_id = high.visit_id)""", """
SELECT visit_id, visit_date, department, CAST(billed_amount AS DOUBLE) AS billed_amount,
  CAST(approved_amount AS DOUBLE) AS approved_amount, claim_status FROM placed WHERE place <= 10""")

B["b11_table_row_counts"] = with_fixtures("""
every AS (SELECT 'patients' AS table_name FROM patients UNION ALL SELECT 'visits' FROM visits
  UNION ALL SELECT 'billing' FROM billing)""", """
SELECT table_name, COUNT(*) AS row_count FROM every GROUP BY table_name""")

B["b12_overall_avg_stay"] = with_fixtures("", """
SELECT ROUND(CAST(SUM(length_of_stay_hours) AS DOUBLE) / COUNT(length_of_stay_hours), 6) AS avg_los FROM visits""")

B["b13_stay_by_department"] = with_fixtures("", """
SELECT DISTINCT department, ROUND(CAST(SUM(length_of_stay_hours) OVER d AS DOUBLE)
    / NULLIF(COUNT(length_of_stay_hours) OVER d, 0), 6) AS avg_los, COUNT(*) OVER d AS visit_count
FROM visits WINDOW d AS (PARTITION BY department)""")

B["b14_visits_by_risk"] = with_fixtures("", """
SELECT DISTINCT risk_score, COUNT(*) OVER (PARTITION BY risk_score) AS cnt FROM visits""")

B["b15_claims_by_status"] = with_fixtures("", """
SELECT DISTINCT claim_status, COUNT(*) OVER s AS cnt, CAST(SUM(billed_amount) OVER s AS DOUBLE) AS sum_billed,
  CAST(SUM(approved_amount) OVER s AS DOUBLE) AS sum_appr
FROM billing WINDOW s AS (PARTITION BY claim_status)""")

B["b16_rejections_by_provider"] = with_fixtures(PROVIDERS, """
SELECT insurance_provider, bills AS total_claims, rejected AS rejected_claims, rejected_sum AS rejected_amount
FROM provider""")

B["b17_payments_by_provider"] = with_fixtures(PROVIDERS, """
SELECT insurance_provider, ROUND(mean_days, 4) AS avg_payment_days, pending AS pending_claims,
  pending_sum AS pending_amount, CAST(billed AS DOUBLE) AS total_billed, CAST(approved AS DOUBLE) AS total_approved
FROM provider""")

B["b18_provider_summary"] = with_fixtures(PROVIDERS, """
SELECT insurance_provider, rows_ AS total_claims, rejected AS rejected_count, ROUND(mean_days, 4) AS avg_pay_days,
  CAST(billed AS DOUBLE) AS total_billed, CAST(approved AS DOUBLE) AS total_approved FROM provider""")
