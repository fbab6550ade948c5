"""Operational and financial BI queries.

All functions take the three table DataFrames and return a DataFrame.
Top-k queries sort by the measure and then by the group key, so results
are deterministic; ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject
(per-partition top-k, then a k-row merge).

Provider-level queries join billing -> visits -> patients.  Instead of
shuffling every joined bill row to the patient side, bills are first
aggregated per patient (map-side partial aggregation collapses a hot
patient), and only one row per patient meets the patients table.
Counts are BIGINT, money and ratios DOUBLE (summed as DECIMAL first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOUBLE = "double"


def _dbl(expr: str, name: str):
    return F.expr(f"CAST({expr} AS DOUBLE)").alias(name)


def visits_by_department(visits: DataFrame, k: int = 10) -> DataFrame:
    """B1: top-k departments by visit count."""
    return (visits.groupBy("department").agg(F.count(F.lit(1)).alias("visit_volume"))
            .orderBy(F.desc("visit_volume"), F.asc_nulls_first("department")).limit(k))


def longest_stay_departments(visits: DataFrame, k: int = 5) -> DataFrame:
    """B2: top-k departments by ROUND(AVG(length_of_stay_hours), 2); AVG skips NULL."""
    agg = visits.groupBy("department").agg(
        F.round(F.avg("length_of_stay_hours"), 2).cast(DOUBLE).alias("avg_length_of_stay_hours"))
    return agg.orderBy(F.desc_nulls_last("avg_length_of_stay_hours"),
                       F.asc_nulls_first("department")).limit(k)


def high_risk_share_by_department(visits: DataFrame) -> DataFrame:
    """Per department total visits, High-risk visits and their percentage."""
    agg = visits.groupBy("department").agg(
        F.count(F.lit(1)).alias("total_visits"),
        F.sum(F.when(F.col("risk_score") == "High", 1).otherwise(0)).cast("bigint")
        .alias("high_risk_visits"))
    return agg.select(
        "department", "total_visits", "high_risk_visits",
        _dbl("round(high_risk_visits * 100.0 / total_visits, 2)", "high_risk_percentage"))


def visits_per_patient_by_city(patients: DataFrame, visits: DataFrame) -> DataFrame:
    """Patients LEFT JOIN visits per city; zero-visit patients count in the denominator."""
    per_patient = visits.where(F.col("visit_id").isNotNull()).groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_visits"))
    joined = patients.select("patient_id", "city").join(per_patient, "patient_id", "left")
    agg = joined.groupBy("city").agg(
        F.coalesce(F.sum("n_visits"), F.lit(0)).cast("bigint").alias("total_visits"),
        F.countDistinct("patient_id").alias("unique_patients"))
    return agg.select(
        "city", "total_visits", "unique_patients",
        _dbl("round(total_visits * 1.0 / unique_patients, 2)", "avg_visits_per_patient"))


def top_high_risk_doctors(visits: DataFrame, k: int = 10) -> DataFrame:
    """Top-k doctors by number of High-risk visits."""
    return (visits.where(F.col("risk_score") == "High").groupBy("doctor_id")
            .agg(F.count(F.lit(1)).alias("high_risk_visits_handled"))
            .orderBy(F.desc("high_risk_visits_handled"), F.asc_nulls_first("doctor_id")).limit(k))


def bills_with_visits(visits: DataFrame, billing: DataFrame) -> DataFrame:
    """Inner join billing to visits on visit_id, keeping the visit's patient and department."""
    v = visits.select("visit_id", "patient_id", "department")
    return billing.join(v, "visit_id", "inner")


def claim_measures_by_provider(patients: DataFrame, visits: DataFrame,
                               billing: DataFrame) -> DataFrame:
    """All provider-level claim measures of patients JOIN visits JOIN billing.

    Partial measures are summed per patient first, then per provider.  Unused
    measures are pruned by Catalyst when a caller selects a subset.
    """
    bills = bills_with_visits(visits, billing)
    rejected = F.col("claim_status") == "Rejected"
    pending = F.col("claim_status") == "Pending"
    per_patient = bills.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("bill_id").alias("n_bills"),
        F.sum(F.when(rejected, 1).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(rejected, F.col("billed_amount")).otherwise(F.lit(0).cast("decimal(10,2)")))
        .alias("rejected_amount"),
        F.sum(F.when(pending, 1).otherwise(0)).alias("n_pending"),
        F.sum(F.when(pending, F.col("billed_amount")).otherwise(F.lit(0).cast("decimal(10,2)")))
        .alias("pending_amount"),
        F.sum("billed_amount").alias("billed"),
        F.sum("approved_amount").alias("approved"),
        F.sum("payment_days").alias("pay_days_sum"),
        F.count("payment_days").alias("pay_days_n"),
    )
    joined = patients.select("patient_id", "insurance_provider").join(per_patient, "patient_id")
    return joined.groupBy("insurance_provider").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_bills").alias("n_bills"),
        F.sum("n_rejected").cast("bigint").alias("n_rejected"),
        F.sum("rejected_amount").alias("rejected_amount"),
        F.sum("n_pending").cast("bigint").alias("n_pending"),
        F.sum("pending_amount").alias("pending_amount"),
        F.sum("billed").alias("billed"),
        F.sum("approved").alias("approved"),
        F.sum("pay_days_sum").alias("pay_days_sum"),
        F.sum("pay_days_n").alias("pay_days_n"),
    )


def _avg_pay_days(scale: int):
    return F.expr(f"CAST(round(pay_days_sum / nullif(pay_days_n, 0), {scale}) AS DOUBLE)")


def billed_by_provider(patients, visits, billing, k: int = 10) -> DataFrame:
    """Top-k insurance providers by total billed amount."""
    m = claim_measures_by_provider(patients, visits, billing)
    out = m.select("insurance_provider", _dbl("round(billed, 2)", "total_billed_amount"))
    return out.orderBy(F.desc_nulls_last("total_billed_amount"),
                       F.asc_nulls_first("insurance_provider")).limit(k)


def rejection_rate_by_provider(patients, visits, billing, k: int = 5) -> DataFrame:
    """Top-k insurance providers by claim rejection percentage."""
    m = claim_measures_by_provider(patients, visits, billing)
    out = m.select(
        "insurance_provider",
        F.col("n_bills").alias("total_claims"),
        F.col("n_rejected").alias("rejected_claims"),
        _dbl("round(n_rejected * 100.0 / nullif(n_bills, 0), 2)", "rejection_rate"))
    return out.orderBy(F.desc_nulls_last("rejection_rate"),
                       F.asc_nulls_first("insurance_provider")).limit(k)


def payment_delay_by_provider(patients, visits, billing) -> DataFrame:
    """ROUND(AVG(payment_days), 1) per provider over bills with payment_days."""
    paid = billing.where(F.col("payment_days").isNotNull())
    m = claim_measures_by_provider(patients, visits, paid)
    return m.select("insurance_provider", _avg_pay_days(1).alias("avg_payment_delay_days"))


def realization_by_department(visits, billing) -> DataFrame:
    """Per department billed, approved and approved / billed."""
    bills = bills_with_visits(visits, billing)
    agg = bills.groupBy("department").agg(
        F.sum("billed_amount").alias("b"), F.sum("approved_amount").alias("a"))
    return agg.select(
        "department",
        _dbl("round(b, 2)", "total_billed"),
        _dbl("round(a, 2)", "total_approved"),
        _dbl("round(a / nullif(b, 0), 4)", "revenue_realization_ratio"))


def unapproved_high_bills(visits, billing, k: int = 10) -> DataFrame:
    """Bills above the average of all bills with approved 0 or NULL, top-k by amount.

    The average is an uncorrelated scalar subquery over the whole billing
    table (not just the joined rows), evaluated once.
    """
    avg_billed = billing.select(F.avg("billed_amount")).scalar()
    v = visits.select("visit_id", "visit_date", "department")
    cand = billing.where(
        (F.col("billed_amount") > avg_billed)
        & ((F.col("approved_amount") == 0) | F.col("approved_amount").isNull()))
    joined = cand.join(v, "visit_id")
    top = joined.orderBy(F.desc("billed_amount"), F.asc("visit_id"), F.asc("bill_id")).limit(k)
    return top.select(
        "visit_id", "visit_date", "department",
        F.round("billed_amount", 2).cast(DOUBLE).alias("billed_amount"),
        F.round("approved_amount", 2).cast(DOUBLE).alias("approved_amount"),
        "claim_status")


def table_row_counts(patients, visits, billing) -> DataFrame:
    """Row count of each table."""
    def one(name, df):
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
    return one("patients", patients).unionByName(one("visits", visits)).unionByName(
        one("billing", billing))


def overall_avg_stay(visits) -> DataFrame:
    """Overall AVG(length_of_stay_hours), six decimals as the SQL AVG of DECIMAL(10,2)."""
    return visits.agg(F.round(F.avg("length_of_stay_hours"), 6).cast(DOUBLE).alias("avg_los"))


def stay_by_department(visits) -> DataFrame:
    """Per department AVG(length_of_stay_hours) and visit count."""
    return visits.groupBy("department").agg(
        F.round(F.avg("length_of_stay_hours"), 6).cast(DOUBLE).alias("avg_los"),
        F.count(F.lit(1)).alias("visit_count"))


def visits_by_risk(visits) -> DataFrame:
    """Visits per risk_score."""
    return visits.groupBy("risk_score").agg(F.count(F.lit(1)).alias("cnt"))


def claims_by_status(billing) -> DataFrame:
    """Per claim_status count, billed and approved sums."""
    return billing.groupBy("claim_status").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum("billed_amount").cast(DOUBLE).alias("sum_billed"),
        F.sum("approved_amount").cast(DOUBLE).alias("sum_appr"))


def rejections_by_provider(patients, visits, billing) -> DataFrame:
    """Per provider claims, rejected count and rejected amount."""
    m = claim_measures_by_provider(patients, visits, billing)
    return m.select(
        "insurance_provider",
        F.col("n_bills").alias("total_claims"),
        F.col("n_rejected").alias("rejected_claims"),
        F.col("rejected_amount").cast(DOUBLE).alias("rejected_amount"))


def payments_by_provider(patients, visits, billing) -> DataFrame:
    """Per provider avg payment days, pending count / amount, billed, approved."""
    m = claim_measures_by_provider(patients, visits, billing)
    return m.select(
        "insurance_provider",
        _avg_pay_days(4).alias("avg_payment_days"),
        F.col("n_pending").alias("pending_claims"),
        F.col("pending_amount").cast(DOUBLE).alias("pending_amount"),
        F.col("billed").cast(DOUBLE).alias("total_billed"),
        F.col("approved").cast(DOUBLE).alias("total_approved"))


def provider_summary(patients, visits, billing) -> DataFrame:
    """Per provider COUNT(*), rejected, avg payment days, billed, approved."""
    m = claim_measures_by_provider(patients, visits, billing)
    return m.select(
        "insurance_provider",
        F.col("n_rows").alias("total_claims"),
        F.col("n_rejected").alias("rejected_count"),
        _avg_pay_days(4).alias("avg_pay_days"),
        F.col("billed").cast(DOUBLE).alias("total_billed"),
        F.col("approved").cast(DOUBLE).alias("total_approved"))
