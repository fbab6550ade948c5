"""DuckDB oracle SQL for audits (Q1-Q10), key contract (S2), cascade delete (S4), master."""

from careops import schema as S
from careops.sources.fixtures import with_fixtures

Q = {}

# audits as complements: the rows that a sound table would not have
Q["q01_visits_without_bill"] = with_fixtures("", """
SELECT visit_id, visit_date, patient_id, department FROM visits
WHERE NOT EXISTS (FROM billing WHERE billing.visit_id = visits.visit_id AND bill_id IS NOT NULL)""")

Q["q02_bills_without_visit"] = with_fixtures("""
lost AS (SELECT visit_id FROM billing EXCEPT SELECT visit_id FROM staging_visits)""", """
SELECT bill_id, visit_id, CAST(billed_amount AS DOUBLE) AS billed_amount, billing_date
FROM billing SEMI JOIN lost USING (visit_id)""")

Q["q03_duplicate_patients"] = with_fixtures("", """
SELECT DISTINCT patient_id, COUNT(*) OVER same AS duplicate_count FROM staging_patients
WINDOW same AS (PARTITION BY patient_id) QUALIFY COUNT(*) OVER same > 1""")

Q["q04_invalid_length_of_stay"] = with_fixtures("", """
SELECT visit_id, CAST(length_of_stay_hours AS DOUBLE) AS length_of_stay_hours FROM visits
WHERE COALESCE(length_of_stay_hours > 0, FALSE) IS FALSE""")

Q["q05_invalid_payment_days"] = with_fixtures("""
sound AS (SELECT bill_id FROM billing WHERE payment_days >= 0
  UNION SELECT bill_id FROM billing WHERE payment_days IS NULL AND claim_status IS DISTINCT FROM 'Paid')""", """
SELECT bill_id, claim_status, payment_days FROM billing ANTI JOIN sound USING (bill_id)""")

Q["q06_visits_missing_insurance"] = with_fixtures("""
uninsured AS (SELECT patient_id, insurance_provider FROM patients
  WHERE regexp_full_match(lower(COALESCE(insurance_provider, 'null')), 'null|\\s*'))""", """
SELECT visit_id, patient_id, insurance_provider FROM uninsured JOIN visits USING (patient_id)""")

Q["q07_q09_validation_report"] = with_fixtures("", """
SELECT 'patients' AS table_name, 'age_range' AS rule,
  COUNT(*) FILTER (WHERE age < 0 OR age > 120) AS failed_rows FROM patients
UNION ALL SELECT 'patients', 'gender_values',
  COUNT(*) FILTER (WHERE gender IS NULL OR gender NOT IN ('M', 'F')) FROM patients
UNION ALL SELECT 'patients', 'chronic_flag_values',
  COUNT(*) FILTER (WHERE chronic_flag IS NULL OR chronic_flag NOT IN (0, 1)) FROM patients
UNION ALL SELECT 'visits', 'length_of_stay_positive',
  COUNT(*) FILTER (WHERE length_of_stay_hours <= 0) FROM visits
UNION ALL SELECT 'visits', 'risk_score_values',
  COUNT(*) FILTER (WHERE risk_score IS NULL OR risk_score NOT IN ('Low', 'Medium', 'High')) FROM visits
UNION ALL SELECT 'billing', 'billed_non_negative', COUNT(*) FILTER (WHERE billed_amount < 0) FROM billing
UNION ALL SELECT 'billing', 'approved_not_above_billed',
  COUNT(*) FILTER (WHERE approved_amount > billed_amount) FROM billing
UNION ALL SELECT 'billing', 'payment_days_non_negative', COUNT(*) FILTER (WHERE payment_days < 0) FROM billing""")

Q["q10_invalid_rows"] = with_fixtures("", """
SELECT * FROM (
  SELECT 'patients' AS table_name, patient_id AS record_id, concat_ws(';',
    CASE WHEN age < 0 OR age > 120 THEN 'age_range' END,
    CASE WHEN gender IS NULL OR gender NOT IN ('M', 'F') THEN 'gender_values' END,
    CASE WHEN chronic_flag IS NULL OR chronic_flag NOT IN (0, 1) THEN 'chronic_flag_values' END) AS reasons
  FROM patients
  UNION ALL
  SELECT 'visits', visit_id, concat_ws(';',
    CASE WHEN length_of_stay_hours <= 0 THEN 'length_of_stay_positive' END,
    CASE WHEN risk_score IS NULL OR risk_score NOT IN ('Low', 'Medium', 'High') THEN 'risk_score_values' END)
  FROM visits
  UNION ALL
  SELECT 'billing', bill_id, concat_ws(';',
    CASE WHEN billed_amount < 0 THEN 'billed_non_negative' END,
    CASE WHEN approved_amount > billed_amount THEN 'approved_not_above_billed' END,
    CASE WHEN payment_days < 0 THEN 'payment_days_non_negative' END)
  FROM billing) t
WHERE reasons <> ''""")

Q["s02_key_contract"] = with_fixtures("""
kp AS (SELECT DISTINCT patient_id FROM staging_patients),
kv AS (SELECT DISTINCT ON (visit_id) * FROM staging_visits),
av AS (SELECT * FROM kv WHERE patient_id IS NULL OR patient_id IN (SELECT patient_id FROM kp)),
kb AS (SELECT DISTINCT ON (bill_id) * FROM billing),
ab AS (SELECT * FROM kb WHERE visit_id IS NULL OR visit_id IN (SELECT visit_id FROM av))""", """
SELECT 'patients' AS table_name, (SELECT COUNT(*) FROM staging_patients) AS staged_rows,
  (SELECT COUNT(*) FROM kp) AS accepted_rows,
  (SELECT COUNT(*) FROM staging_patients) - (SELECT COUNT(*) FROM kp) AS rejected_pk,
  CAST(0 AS BIGINT) AS rejected_fk
UNION ALL SELECT 'visits', (SELECT COUNT(*) FROM staging_visits), (SELECT COUNT(*) FROM av),
  (SELECT COUNT(*) FROM staging_visits) - (SELECT COUNT(*) FROM kv), (SELECT COUNT(*) FROM kv) - (SELECT COUNT(*) FROM av)
UNION ALL SELECT 'billing', (SELECT COUNT(*) FROM billing), (SELECT COUNT(*) FROM ab),
  (SELECT COUNT(*) FROM billing) - (SELECT COUNT(*) FROM kb), (SELECT COUNT(*) FROM kb) - (SELECT COUNT(*) FROM ab)""")

Q["s04_cascade_delete"] = with_fixtures("""
dead AS (SELECT patient_id FROM patients WHERE insurance_provider IS NULL
  OR TRIM(insurance_provider) = '' OR LOWER(insurance_provider) = 'null'),
dv AS (SELECT visit_id FROM visits WHERE patient_id IN (SELECT patient_id FROM dead))""", """
SELECT 'patients' AS table_name, COUNT(*) AS rows_before,
  COUNT(*) FILTER (WHERE patient_id NOT IN (SELECT patient_id FROM dead)) AS rows_after,
  COUNT(*) FILTER (WHERE patient_id IN (SELECT patient_id FROM dead)) AS rows_deleted FROM patients
UNION ALL SELECT 'visits', COUNT(*),
  COUNT(*) FILTER (WHERE patient_id IS NULL OR patient_id NOT IN (SELECT patient_id FROM dead)),
  COUNT(*) FILTER (WHERE patient_id IN (SELECT patient_id FROM dead)) FROM visits
UNION ALL SELECT 'billing', COUNT(*),
  COUNT(*) FILTER (WHERE visit_id IS NULL OR visit_id NOT IN (SELECT visit_id FROM dv)),
  COUNT(*) FILTER (WHERE visit_id IN (SELECT visit_id FROM dv)) FROM billing""")

_LEFT = """
dead AS (SELECT patient_id FROM patients WHERE insurance_provider IS NULL
  OR TRIM(insurance_provider) = '' OR LOWER(insurance_provider) = 'null'),
left_patients AS (SELECT * FROM patients ANTI JOIN dead USING (patient_id)),
gone_visits AS (SELECT * FROM visits SEMI JOIN dead USING (patient_id)),
left_visits AS (SELECT * FROM visits ANTI JOIN gone_visits USING (visit_id)),
left_billing AS (SELECT * FROM billing ANTI JOIN gone_visits USING (visit_id))"""
Q["s04_cascaded_patients"] = with_fixtures(_LEFT, "SELECT * FROM left_patients")
Q["s04_cascaded_visits"] = with_fixtures(_LEFT, """
SELECT * REPLACE (CAST(length_of_stay_hours AS DOUBLE) AS length_of_stay_hours) FROM left_visits""")
Q["s04_cascaded_billing"] = with_fixtures(_LEFT, """
SELECT * REPLACE (CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(approved_amount AS DOUBLE) AS approved_amount)
FROM left_billing""")

_STRIPPED = ("gender", "city", "insurance_provider")


def _master_sql() -> str:
    """Visits with what is known of their patient, met with the bills; texts without white space at their ends."""
    columns = ", ".join(rf"regexp_replace({c}, '^\s+|\s+$', '', 'g') AS {c}" if c in _STRIPPED else c for c in S.MASTER_COLUMNS)
    return f"""known_visits AS (SELECT * FROM visits LEFT JOIN patients USING (patient_id)),
master AS (SELECT {columns} FROM known_visits LEFT JOIN billing USING (visit_id))"""


MASTER_SQL = _master_sql()

Q["s06_master_frame"] = with_fixtures(MASTER_SQL, """
SELECT visit_id, patient_id, visit_date, department, visit_type,
  CAST(length_of_stay_hours AS DOUBLE) AS length_of_stay_hours, risk_score, doctor_id,
  age, gender, city, insurance_provider, chronic_flag, registration_date, bill_id,
  CAST(billed_amount AS DOUBLE) AS billed_amount, CAST(approved_amount AS DOUBLE) AS approved_amount,
  claim_status, payment_days, billing_date
FROM master""")
