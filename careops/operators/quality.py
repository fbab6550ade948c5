"""Data-quality and integrity audits (Q1-Q10).

Orphan checks are anti-joins written as ``left_anti`` (Spark does not turn
LEFT JOIN ... IS NULL into an anti-join by itself).  Rule counts are one
aggregate pass per table; the invalid-row split tags every row with an
array of reasons, so nothing leaves the executors.

Null rules follow the reference: ``<``, ``>``, ``<=`` on NULL pass, while a
"value not in the allowed set" rule fails on NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careops import schema as S


def visits_without_bill(visits: DataFrame, billing: DataFrame) -> DataFrame:
    """Q1: visits that no bill points at."""
    return visits.join(billing.select("visit_id"), "visit_id", "left_anti").select(
        "visit_id", "visit_date", "patient_id", "department")


def bills_without_visit(visits: DataFrame, billing: DataFrame) -> DataFrame:
    """Q2: bills whose visit does not exist."""
    return billing.join(visits.select("visit_id"), "visit_id", "left_anti").select(
        "bill_id", "visit_id", "billed_amount", "billing_date")


def duplicate_keys(df: DataFrame, key: str = "patient_id") -> DataFrame:
    """Q3: keys that occur more than once, with their count (map-side partial counts)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("duplicate_count"))
            .where(F.col("duplicate_count") > 1))


def invalid_length_of_stay(visits: DataFrame) -> DataFrame:
    """Q4: length of stay NULL or not positive."""
    los = F.col("length_of_stay_hours")
    return visits.where(los.isNull() | (los <= 0)).select("visit_id", "length_of_stay_hours")


def invalid_payment_days(billing: DataFrame) -> DataFrame:
    """Q5: negative payment days, or a Paid claim without payment days."""
    pdays = F.col("payment_days")
    cond = (pdays < 0) | ((F.col("claim_status") == "Paid") & pdays.isNull())
    return billing.where(cond).select("bill_id", "claim_status", "payment_days")


def missing_provider_condition(col: Column) -> Column:
    return col.isNull() | (F.trim(col) == "") | (F.lower(col) == "null")


def visits_missing_insurance(patients: DataFrame, visits: DataFrame) -> DataFrame:
    """Q6: visits whose patient has no usable insurance provider."""
    p = patients.select("patient_id", "insurance_provider").where(
        missing_provider_condition(F.col("insurance_provider")))
    return visits.select("visit_id", "patient_id").join(p, "patient_id").select(
        "visit_id", "patient_id", "insurance_provider")


# --- validation rules (Q7-Q9) -------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    table: str
    name: str
    columns: tuple[str, ...]
    message: str

    def failing(self) -> Column:
        return _RULE_EXPR[(self.table, self.name)]()


def _not_in(col: str, allowed) -> Column:
    # NULL counts as not allowed, like pandas ~isin
    return F.coalesce(~F.col(col).isin(list(allowed)), F.lit(True))


_RULE_EXPR = {
    ("patients", "age_range"): lambda: (F.col("age") < S.AGE_RANGE[0]) | (F.col("age") > S.AGE_RANGE[1]),
    ("patients", "gender_values"): lambda: _not_in("gender", S.GENDERS),
    ("patients", "chronic_flag_values"): lambda: _not_in("chronic_flag", S.CHRONIC_FLAGS),
    ("visits", "length_of_stay_positive"): lambda: F.col("length_of_stay_hours") <= 0,
    ("visits", "risk_score_values"): lambda: _not_in("risk_score", S.RISK_CLASSES),
    ("billing", "billed_non_negative"): lambda: F.col("billed_amount") < 0,
    ("billing", "approved_not_above_billed"): lambda: F.col("approved_amount") > F.col("billed_amount"),
    ("billing", "payment_days_non_negative"): lambda: F.col("payment_days") < 0,
}

RULES = [
    Rule("patients", "age_range", ("age",), "age below 0 or above 120"),
    Rule("patients", "gender_values", ("gender",), "gender is neither 'M' nor 'F'"),
    Rule("patients", "chronic_flag_values", ("chronic_flag",), "flag is neither 0 nor 1"),
    Rule("visits", "length_of_stay_positive", ("length_of_stay_hours",), "stay of zero or fewer hours"),
    Rule("visits", "risk_score_values", ("risk_score",), "risk class is not one of Low, Medium, High"),
    Rule("billing", "billed_non_negative", ("billed_amount",), "billed amount below zero"),
    Rule("billing", "approved_not_above_billed", ("approved_amount", "billed_amount"),
         "approved more than was billed"),
    Rule("billing", "payment_days_non_negative", ("payment_days",), "payment days below zero"),
]


def rules_for(table: str, df: DataFrame) -> list[Rule]:
    """Rules of ``table`` whose columns all exist in ``df`` (missing columns skip a rule)."""
    cols = set(df.columns)
    return [r for r in RULES if r.table == table and set(r.columns) <= cols]


def validate(df: DataFrame, table: str) -> DataFrame:
    """Q7/Q8/Q9: one aggregate pass; one row per applicable rule (table_name, rule, failed_rows)."""
    rules = rules_for(table, df)
    if not rules:
        return df.sparkSession.createDataFrame([], "table_name string, rule string, failed_rows bigint")
    counts = df.agg(*[F.count_if(r.failing()).alias(r.name) for r in rules])
    stack = "stack({n}, {pairs}) AS (rule, failed_rows)".format(
        n=len(rules), pairs=", ".join(f"'{r.name}', `{r.name}`" for r in rules))
    return counts.selectExpr(f"'{table}' AS table_name", stack)


def validation_report(patients: DataFrame, visits: DataFrame, billing: DataFrame) -> DataFrame:
    """Q7-Q9 over all three tables."""
    return validate(patients, "patients").unionByName(validate(visits, "visits")).unionByName(
        validate(billing, "billing"))


def validation_result(report: DataFrame) -> dict:
    """The reference's ``{success, errors}`` shape from a (small, per-rule) report."""
    msgs = {(r.table, r.name): r.message for r in RULES}
    errors = [f"{row.table_name}.{row.rule}: found {row.failed_rows} {msgs[(row.table_name, row.rule)]}"
              for row in report.where("failed_rows > 0").collect()]
    return {"success": not errors, "errors": errors}


def with_reasons(df: DataFrame, table: str) -> DataFrame:
    """Q10: add ``reasons`` (array of failed rule names, empty when valid)."""
    rules = rules_for(table, df)
    arr = F.array(*[F.when(F.coalesce(r.failing(), F.lit(False)), F.lit(r.name)) for r in rules]) \
        if rules else F.array().cast("array<string>")
    return df.withColumn("reasons", F.array_compact(arr))


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Q10: (valid rows, invalid rows with reasons); one tagging pass, two filters."""
    tagged = with_reasons(df, table)
    valid = tagged.where(F.size("reasons") == 0).drop("reasons")
    invalid = tagged.where(F.size("reasons") > 0)
    return valid, invalid


def invalid_rows(patients: DataFrame, visits: DataFrame, billing: DataFrame) -> DataFrame:
    """Q10 report: every invalid row of the three tables with its reasons joined by ';'."""
    out = None
    for table, df in (("patients", patients), ("visits", visits), ("billing", billing)):
        key = S.PRIMARY_KEYS[table]
        _, bad = split_valid(df, table)
        part = bad.select(F.lit(table).alias("table_name"), F.col(key).alias("record_id"),
                          F.concat_ws(";", "reasons").alias("reasons"))
        out = part if out is None else out.unionByName(part)
    return out
