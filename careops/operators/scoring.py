"""Batch scoring of risk and claim requests.

The reference scores one HTTP request at a time; here a request is a row.
C1 checks every field like the request schema does (all required, ranges),
C2 hashes the raw input, C3 joins the scoring-time rates (F13), C4/C5 apply a fitted model.  The streaming
driver of the same steps is ``careops.streaming.scoring``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops.functions.joins import lookup
from careops.operators.features import Aggregates

# --- fixed values: request fields and their allowed ranges ---
RISK_FIELDS = ["age", "gender", "city", "chronic_flag", "length_of_stay_hours", "department",
               "visit_type", "days_since_registration", "visit_month", "visit_day_of_week",
               "visit_frequency", "avg_length_of_stay_patient"]
CLAIM_FIELDS = RISK_FIELDS + ["risk_score", "billed_amount", "insurance_provider"]
RANGES = {
    "age": (0, 120), "chronic_flag": (0, 1), "length_of_stay_hours": (0, None),
    "days_since_registration": (0, None), "visit_month": (1, 12), "visit_day_of_week": (0, 6),
    "visit_frequency": (1, None), "avg_length_of_stay_patient": (0, None), "billed_amount": (0, None),
}
# --- end of fixed values ---

_TYPES = {"age": T.LongType(), "chronic_flag": T.LongType(), "days_since_registration": T.LongType(),
          "visit_month": T.LongType(), "visit_day_of_week": T.LongType(), "visit_frequency": T.LongType(),
          "length_of_stay_hours": T.DoubleType(), "avg_length_of_stay_patient": T.DoubleType(),
          "billed_amount": T.DoubleType()}

RISK_REQUEST = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in RISK_FIELDS])
CLAIM_REQUEST = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in CLAIM_FIELDS])


def requests_from(model_rows: DataFrame, fields: Sequence[str] = CLAIM_FIELDS,
                  keys: Sequence[str] = ("visit_id", "bill_id")) -> DataFrame:
    """Requests as a client would send them, built from model-table rows (typed like the schema)."""
    return model_rows.select(*keys, *[F.col(c).cast(_TYPES.get(c, T.StringType())).alias(c) for c in fields])


def check_requests(df: DataFrame, fields: Sequence[str] = CLAIM_FIELDS) -> DataFrame:
    """Add ``reasons`` (array): ``missing:<field>`` and ``range:<field>`` per failed check."""
    checks = []
    for c in fields:
        checks.append(F.when(F.col(c).isNull(), F.lit(f"missing:{c}")))
        if c in RANGES:
            lo, hi = RANGES[c]
            bad = F.col(c) < lo
            if hi is not None:
                bad = bad | (F.col(c) > hi)
            checks.append(F.when(bad, F.lit(f"range:{c}")))
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def request_json(fields: Sequence[str] = CLAIM_FIELDS):
    """The raw request as key-sorted JSON text (no spaces, UTF-8); a NULL field is written as null."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(fields)]), {"ignoreNullFields": "false"})


def feature_hash(fields: Sequence[str] = CLAIM_FIELDS):
    """SHA-256 hex of the key-sorted JSON of the raw request."""
    return F.sha2(request_json(fields), 256)


def claim_enricher(rates: Aggregates) -> Callable[[DataFrame], DataFrame]:
    """C3 with the rates computed once, for any number of batches of requests."""
    providers, departments, g = lookup(rates.provider_rejection), lookup(rates.dept_realization), rates.globals

    def enrich(df: DataFrame) -> DataFrame:
        out = df.join(providers, "insurance_provider", "left").join(departments, "department", "left")
        return (out.withColumn("provider_rejection_rate",
                               F.coalesce("provider_rejection_rate", g.select("global_rejection").scalar()))
                .withColumn("revenue_realization_rate_dept",
                            F.coalesce("revenue_realization_rate_dept", g.select("global_realization").scalar())))
    return enrich


def enrich_claims(df: DataFrame, rates: Aggregates) -> DataFrame:
    """Provider and department rates, unseen keys -> the global rates."""
    return claim_enricher(rates)(df)
