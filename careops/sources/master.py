"""The joined master frame (S6): visits LEFT JOIN patients LEFT JOIN billing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careops import schema as S


def strip_ws(col: str):
    """Remove leading / trailing whitespace of any kind (SQL TRIM removes only spaces)."""
    return F.regexp_replace(F.col(col), r"^\s+|\s+$", "")


def load_joined(patients: DataFrame, visits: DataFrame, billing: DataFrame) -> DataFrame:
    """20-column master frame, one row per (visit, bill); visits without a bill keep NULL bill columns.

    Both joins are equi-joins on keys: the planner shuffles each side once on
    the key (or broadcasts a side AQE measures as small).  Ordering by
    visit_date is left to the consumer that needs it.
    """
    p = patients.select(
        "patient_id", "age",
        strip_ws("gender").alias("gender"), strip_ws("city").alias("city"),
        strip_ws("insurance_provider").alias("insurance_provider"),
        "chronic_flag", F.to_date("registration_date").alias("registration_date"))
    v = visits.select(
        "visit_id", "patient_id", F.to_date("visit_date").alias("visit_date"), "department",
        "visit_type", F.col("length_of_stay_hours").cast("decimal(10,2)").alias("length_of_stay_hours"),
        "risk_score", "doctor_id")
    b = billing.select(
        "bill_id", "visit_id",
        F.col("billed_amount").cast("decimal(10,2)").alias("billed_amount"),
        F.col("approved_amount").cast("decimal(10,2)").alias("approved_amount"),
        "claim_status", F.col("payment_days").cast("int").alias("payment_days"),
        F.to_date("billing_date").alias("billing_date"))
    joined = v.join(p, "patient_id", "left").join(b, "visit_id", "left")
    return joined.select(*S.MASTER_COLUMNS)
