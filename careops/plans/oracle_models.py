"""DuckDB oracle SQL for model-side tables that SQL can express."""

from careops import schema as S
from careops.plans.oracle_drift import K as _K_SQL
from careops.plans.oracle_features import F as _F_SQL
from careops.plans.oracle_features import MODEL_TABLE_SQL, RATES_SQL
from careops.sources.fixtures import with_fixtures

M = {}

M["m02_target_distribution"] = with_fixtures(MODEL_TABLE_SQL + """,
t AS (SELECT * FROM model_table WHERE risk_score IS NOT NULL AND claim_status IS NOT NULL)""", """
SELECT 'risk_score' AS target, risk_score AS value, round_even(COUNT(*) / (SELECT COUNT(*) FROM t), 3) AS share
FROM t GROUP BY risk_score
UNION ALL SELECT 'claim_status', claim_status, round_even(COUNT(*) / (SELECT COUNT(*) FROM t), 3)
FROM t GROUP BY claim_status""")

M["m05_class_weights"] = with_fixtures(MODEL_TABLE_SQL + """,
t AS (SELECT CASE claim_status WHEN 'Paid' THEN 0 WHEN 'Pending' THEN 1 WHEN 'Rejected' THEN 2 END AS label
  FROM model_table WHERE split = 'train' AND risk_score IS NOT NULL AND claim_status IS NOT NULL),
c AS (SELECT label, COUNT(*) AS n FROM t GROUP BY label)""", """
SELECT CAST(label AS DOUBLE) AS claim_label, ROUND((SELECT COUNT(*) FROM t) / ((SELECT COUNT(*) FROM c) * n), 6)
  AS class_weight FROM c""")

_REQ = MODEL_TABLE_SQL + """,
req AS (SELECT visit_id, bill_id, CAST(age AS BIGINT) AS age, gender, city, CAST(chronic_flag AS BIGINT) AS chronic_flag,
  CAST(length_of_stay_hours AS DOUBLE) AS length_of_stay_hours, department, visit_type,
  CAST(days_since_registration AS BIGINT) AS days_since_registration, CAST(visit_month AS BIGINT) AS visit_month,
  CAST(visit_day_of_week AS BIGINT) AS visit_day_of_week, CAST(visit_frequency AS BIGINT) AS visit_frequency,
  CAST(avg_length_of_stay_patient AS DOUBLE) AS avg_length_of_stay_patient, risk_score,
  CAST(billed_amount AS DOUBLE) AS billed_amount, insurance_provider
  FROM model_table)"""

# --- fixed values: request fields and their allowed ranges ---
_FIELDS = ["age", "gender", "city", "chronic_flag", "length_of_stay_hours", "department", "visit_type",
           "days_since_registration", "visit_month", "visit_day_of_week", "visit_frequency",
           "avg_length_of_stay_patient", "risk_score", "billed_amount", "insurance_provider"]
_RANGES = {"age": (0, 120), "chronic_flag": (0, 1), "length_of_stay_hours": (0, None),
           "days_since_registration": (0, None), "visit_month": (1, 12), "visit_day_of_week": (0, 6),
           "visit_frequency": (1, None), "avg_length_of_stay_patient": (0, None), "billed_amount": (0, None)}
# --- end of fixed values ---


def _checks(fields=_FIELDS):
    parts = []
    for c in fields:
        parts.append(f"CASE WHEN {c} IS NULL THEN 'missing:{c}' END")
        if c in _RANGES:
            lo, hi = _RANGES[c]
            cond = f"{c} < {lo}" + (f" OR {c} > {hi}" if hi is not None else "")
            parts.append(f"CASE WHEN {cond} THEN 'range:{c}' END")
    return ",\n  ".join(parts)


M["c01_claim_request_check"] = with_fixtures(_REQ, f"""
SELECT visit_id, bill_id, r AS reasons, r = '' AS valid FROM (
SELECT visit_id, bill_id, concat_ws(';',
  {_checks()}) AS r FROM req) t""")

def _json(fields) -> str:
    """The request as JSON with sorted keys, without spaces; numbers in their shortest form."""
    text = {"gender", "city", "department", "visit_type", "risk_score", "insurance_provider"}
    parts = [f"""'"{c}":' || COALESCE({f"CAST(to_json({c}) AS VARCHAR)" if c in text else f"CAST({c} AS VARCHAR)"}, 'null')"""
             for c in sorted(fields)]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


M["c02_feature_hash"] = with_fixtures(_REQ, f"""
SELECT visit_id, bill_id, sha256({_json(_FIELDS)}) AS feature_hash FROM req""")

M["s08_s09_audit_tail"] = with_fixtures(_REQ, f"""
SELECT CAST(0 AS BIGINT) AS batch_id, '/predict/claim' AS endpoint, prediction, 'rule-baseline' AS model_version,
  sha256(input) AS feature_hash, age, billed_amount
FROM (SELECT *, md5(concat_ws(':', '/predict/claim', input, prediction, 'rule-baseline', visit_id, bill_id)) AS row_id
  FROM (SELECT *, {_json(_FIELDS)} AS input,
    CASE WHEN risk_score = 'High' THEN 'Rejected' WHEN visit_type = 'ER' THEN 'Pending' ELSE 'Paid' END AS prediction FROM req))
ORDER BY row_id DESC LIMIT 10""")

def _stream(fields, rule: str) -> str:
    """What the scoring stream writes: every request once, scored and recorded, or rejected."""
    return with_fixtures(_REQ + f""",
asked AS (SELECT sha256({_json(fields)}) AS feature_hash, {rule} AS result, concat_ws(';',
  {_checks(fields)}) AS reasons FROM req)""", """
SELECT 'scored' AS output, feature_hash, result FROM asked WHERE reasons = ''
UNION ALL SELECT 'audit', feature_hash, result FROM asked WHERE reasons = ''
UNION ALL SELECT 'rejects', feature_hash, reasons FROM asked WHERE reasons <> ''""")


M["c06_risk_scoring_stream"] = _stream(
    _FIELDS[:12], "CASE WHEN length_of_stay_hours >= 40 THEN 'High' WHEN length_of_stay_hours >= 20 THEN 'Medium' ELSE 'Low' END")
M["c06_claim_scoring_stream"] = _stream(
    _FIELDS, "CASE WHEN risk_score = 'High' THEN 'Rejected' WHEN visit_type = 'ER' THEN 'Pending' ELSE 'Paid' END")

M["c03_claim_enrichment"] = with_fixtures(_REQ + "," + RATES_SQL, """
SELECT req.visit_id, req.bill_id,
  COALESCE(p.part / p.whole, (SELECT rate FROM totals WHERE kind = 'provider_rejection')) AS provider_rejection_rate,
  COALESCE(d.part / d.whole, (SELECT rate FROM totals WHERE kind = 'dept_realization')) AS revenue_realization_rate_dept
FROM req LEFT JOIN shares p ON p.kind = 'provider_rejection' AND p.key = req.insurance_provider
LEFT JOIN shares d ON d.kind = 'dept_realization' AND d.key = req.department""")

M["m10_fold_counts"] = with_fixtures(MODEL_TABLE_SQL + """,
t AS (SELECT CASE risk_score WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS label
  FROM model_table WHERE split = 'train' AND risk_score IS NOT NULL AND claim_status IS NOT NULL),
dealt AS (SELECT label, (ROW_NUMBER() OVER (PARTITION BY label) - 1) % 3 AS fold FROM t)""", """
SELECT CAST(label AS INT) AS label, CAST(fold AS INT) AS fold, COUNT(*) AS row_count FROM dealt GROUP BY ALL""")

M["m10_search_claim_joint"] = with_fixtures(MODEL_TABLE_SQL + """,
t AS (SELECT claim_status FROM model_table WHERE split = 'train' AND risk_score IS NOT NULL AND claim_status IS NOT NULL),
dealt AS (SELECT (ROW_NUMBER() OVER (PARTITION BY claim_status) - 1) % 3 AS fold FROM t),
size AS (SELECT fold, COUNT(*) AS row_count FROM dealt GROUP BY fold)""", """
SELECT CAST(i AS INT) AS max_iter, CAST(d AS INT) AS max_depth, CAST(s AS DOUBLE) AS step_size, CAST(fold AS INT) AS fold,
  row_count, TRUE AS is_share, TRUE AS choice_is_best
FROM size, (VALUES (50), (100)) a(i), (VALUES (5), (8), (10)) b(d), (VALUES (0.05), (0.1)) c(s)""")

_TARGETS = MODEL_TABLE_SQL + """,
target AS (SELECT *, CASE risk_score WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS risk,
    CASE claim_status WHEN 'Paid' THEN 0 WHEN 'Pending' THEN 1 WHEN 'Rejected' THEN 2 END AS claim
  FROM model_table WHERE risk_score IS NOT NULL AND claim_status IS NOT NULL)"""


def _encoded(numeric, categorical) -> str:
    """Filled with the training mean, then less it and over the filled training values' deviation."""
    fills = ", ".join(f"AVG(CAST({c} AS DOUBLE)) FILTER (split = 'train') AS m_{c}" for c in numeric)
    filled = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), m_{c}) AS f_{c}" for c in numeric)
    spread = ", ".join(f"STDDEV_SAMP(f_{c}) FILTER (split = 'train') AS s_{c}" for c in numeric)
    cats = ", ".join(f"CASE WHEN TRIM({c}) = '' THEN '<blank>' ELSE {c} END AS c_{c}" for c in categorical)
    nums = ", ".join(f"ROUND(COALESCE((f_{c} - m_{c}) / NULLIF(s_{c}, 0), 0), 6) AS num_{c}" for c in numeric)
    known = ", ".join(
        f"CASE WHEN c_{c} IN (SELECT c_{c} FROM filled WHERE split = 'train') THEN c_{c} END AS cat_{c}" for c in categorical)
    return with_fixtures(_TARGETS + f""",
fill AS (SELECT {fills} FROM target),
filled AS (SELECT visit_id, bill_id, split, {filled}, {cats} FROM target, fill),
spread AS (SELECT {spread} FROM filled)""", f"SELECT visit_id, bill_id, {nums}, {known} FROM filled, spread, fill")


def _scored_rows(label: str, numeric) -> str:
    missing = " + ".join(f"CAST({c} IS NULL AS INT)" for c in numeric)
    return with_fixtures(_TARGETS, f"""
SELECT visit_id, bill_id, split, CAST({label} AS INT) AS actual_label, CAST({missing} AS INT) AS n_filled,
  CAST(1 AS DOUBLE) AS p_sum, TRUE AS is_largest FROM target""")


M["m03_m04_encoded_rows_risk"] = _encoded(S.NUMERIC_A, S.CATEGORICAL_A)
M["m03_m04_encoded_rows_claim"] = _encoded(S.NUMERIC_B, S.CATEGORICAL_B)
M["v01_scored_rows_risk_logistic"] = _scored_rows("risk", S.NUMERIC_A)
M["v01_scored_rows_claim_logistic"] = _scored_rows("claim", S.NUMERIC_B)

M["m11_persisted_risk_logistic"] = with_fixtures(_TARGETS, "SELECT visit_id, bill_id, TRUE AS scores_alike FROM target")

_PLAIN = {
    "patients": "SELECT * FROM patients",
    "visits": """SELECT visit_id, patient_id, visit_date, department, visit_type,
  CAST(length_of_stay_hours AS DOUBLE) AS length_of_stay_hours, risk_score, doctor_id FROM visits""",
    "billing": """SELECT bill_id, visit_id, CAST(billed_amount AS DOUBLE) AS billed_amount,
  CAST(approved_amount AS DOUBLE) AS approved_amount, claim_status, payment_days, billing_date FROM billing""",
}
for _name, _sql in _PLAIN.items():
    M[f"s03_reloaded_{_name}"] = with_fixtures("", _sql)
    M[f"s01_csv_roundtrip_{_name}"] = with_fixtures("", _sql)
# CSV has no empty string apart from a missing value, and 'null' stands for one
M["s01_csv_roundtrip_patients"] = with_fixtures("", """
SELECT * REPLACE (CASE WHEN insurance_provider IN ('', 'null') THEN NULL ELSE insurance_provider END AS insurance_provider)
FROM patients""")

M["s07_exported_model_table"] = _F_SQL["f06_f12_model_table"]

M["s10_drift_sink"] = _K_SQL["k05_drift_report"]

M["s03_s05_reload_counts"] = with_fixtures("", """
SELECT 'patients' AS table_name, COUNT(*) AS row_count FROM patients
UNION ALL SELECT 'visits', COUNT(*) FROM visits UNION ALL SELECT 'billing', COUNT(*) FROM billing""")

M["s07_model_table_export"] = with_fixtures(MODEL_TABLE_SQL, """
SELECT split, COUNT(*) AS row_count FROM model_table GROUP BY split""")
