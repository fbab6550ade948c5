"""Table schemas, column roles and allowed values."""

from __future__ import annotations

from pyspark.sql import types as T

PATIENTS = T.StructType([
    T.StructField("patient_id", T.LongType(), False),
    T.StructField("age", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("insurance_provider", T.StringType()),
    T.StructField("chronic_flag", T.IntegerType()),
    T.StructField("registration_date", T.DateType()),
])

VISITS = T.StructType([
    T.StructField("visit_id", T.LongType(), False),
    T.StructField("patient_id", T.LongType()),
    T.StructField("visit_date", T.DateType()),
    T.StructField("department", T.StringType()),
    T.StructField("visit_type", T.StringType()),
    T.StructField("length_of_stay_hours", T.DecimalType(10, 2)),
    T.StructField("risk_score", T.StringType()),
    T.StructField("doctor_id", T.IntegerType()),
])

BILLING = T.StructType([
    T.StructField("bill_id", T.LongType(), False),
    T.StructField("visit_id", T.LongType()),
    T.StructField("billed_amount", T.DecimalType(10, 2)),
    T.StructField("approved_amount", T.DecimalType(10, 2)),
    T.StructField("claim_status", T.StringType()),
    T.StructField("payment_days", T.IntegerType()),
    T.StructField("billing_date", T.DateType()),
])

TABLES = {"patients": PATIENTS, "visits": VISITS, "billing": BILLING}
PRIMARY_KEYS = {"patients": "patient_id", "visits": "visit_id", "billing": "bill_id"}
# child table -> (fk column, parent table)
FOREIGN_KEYS = {"visits": ("patient_id", "patients"), "billing": ("visit_id", "visits")}

# The 20 columns of the joined master frame, in output order.
MASTER_COLUMNS = [
    "visit_id", "patient_id", "visit_date", "department", "visit_type",
    "length_of_stay_hours", "risk_score", "doctor_id",
    "age", "gender", "city", "insurance_provider", "chronic_flag", "registration_date",
    "bill_id", "billed_amount", "approved_amount", "claim_status", "payment_days", "billing_date",
]

ENGINEERED_COLUMNS = [
    "days_since_registration", "visit_month", "visit_day_of_week", "visit_frequency",
    "avg_length_of_stay_patient", "provider_rejection_rate", "revenue_realization_rate_dept",
]

# --- fixed values: they must equal the reference's for the same results ---
# Target classes in label order (index = encoded label).
RISK_CLASSES = ["Low", "Medium", "High"]
CLAIM_CLASSES = ["Paid", "Pending", "Rejected"]
# Allowed values for validation rules.
GENDERS = ["M", "F"]
CHRONIC_FLAGS = [0, 1]
AGE_RANGE = (0, 120)
# Model A and B feature lists.
FEATURES_A = [
    "age", "gender", "city", "chronic_flag",
    "length_of_stay_hours", "department", "visit_type",
    "days_since_registration", "visit_month", "visit_day_of_week",
    "visit_frequency", "avg_length_of_stay_patient",
]
NUMERIC_A = ["age", "length_of_stay_hours", "days_since_registration", "visit_month",
             "visit_day_of_week", "visit_frequency", "avg_length_of_stay_patient"]
CATEGORICAL_A = ["gender", "city", "department", "visit_type"]
FEATURES_B = FEATURES_A + [
    "risk_score", "billed_amount", "insurance_provider",
    "provider_rejection_rate", "revenue_realization_rate_dept",
]
NUMERIC_B = NUMERIC_A + ["billed_amount", "provider_rejection_rate", "revenue_realization_rate_dept"]
CATEGORICAL_B = CATEGORICAL_A + ["risk_score", "insurance_provider"]
# Columns a model must never see.
FORBIDDEN_A = ["billed_amount", "approved_amount", "claim_status", "payment_days",
               "billing_date", "bill_id", "insurance_provider",
               "provider_rejection_rate", "revenue_realization_rate_dept"]
FORBIDDEN_B = ["approved_amount", "payment_days"]
# Drift analysis columns.
DRIFT_NUMERIC = ["age", "length_of_stay_hours", "billed_amount", "days_since_registration"]
DRIFT_CATEGORICAL = ["department", "visit_type", "insurance_provider", "risk_score", "claim_status"]
# Drift thresholds.
KS_ALPHA = 0.05
PSI_SIGNIFICANT = 0.25
PSI_MODERATE = 0.1
PSI_MISSING_SHARE = 0.0001
PSI_BINS = 10
PSI_MIN_DISTINCT = 5
# Governance thresholds.
RETRAIN_MIN_ACCURACY = 0.70
RETRAIN_MIN_REJECTED_RECALL = 0.70
RETRAIN_MAX_PSI = 0.25
RETRAIN_MAX_AGE_MONTHS = 6
PROMOTION_TOLERANCE = 0.005
# Tokens that pandas' CSV reader treats as missing (exact, case-sensitive).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]
# --- end of fixed values ---
