"""Model governance checks (W1-W4), stated in the reference's documents.

* W1 weekly audit metrics: accuracy and Rejected recall per 7-day event-time
  window (``window`` aligned to the epoch, as Structured Streaming does;
  the streaming form lives in ``careops.streaming.audit``).
* W2 retrain triggers: accuracy or Rejected recall below 0.70, a PSI above
  0.25, or a model older than 6 months.
* W3 training pull: the latest 6 months of visits, Pending claims excluded,
  rows that fail a validation rule excluded.
* W4 promotion gate: candidate accuracy >= active accuracy - 0.005 on the
  same held-out rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops import schema as S
from careops.functions.joins import null_safe_join
from careops.streaming.audit import utc_date
from careops.operators.quality import RULES, _RULE_EXPR


def weekly_metrics(scored: DataFrame, ts: str, actual: str, pred: str, positive: int = 2,
                   window: str = "7 days") -> DataFrame:
    """Per event-time window: volume, accuracy, recall of the positive class.

    Dates become wall-clock timestamps (TIMESTAMP_NTZ) and instants are dated in
    UTC, so the epoch-aligned windows do not move with the session time zone.
    """
    col, to_date = F.col(ts), F.to_date
    if isinstance(scored.schema[ts].dataType, T.DateType):
        col = col.cast("timestamp_ntz")
    elif isinstance(scored.schema[ts].dataType, T.TimestampType):
        to_date = utc_date
    w = F.window(col, window)
    agg = scored.groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("volume"),
        F.count_if(F.col(actual) == F.col(pred)).alias("_hits"),
        F.count_if(F.col(actual) == positive).alias("_pos"),
        F.count_if((F.col(actual) == positive) & (F.col(pred) == positive)).alias("_tp"))
    return agg.select(
        to_date(F.col("w.start")).alias("week_start"), to_date(F.col("w.end")).alias("week_end"), "volume",
        F.round(F.col("_hits") / F.col("volume"), 6).alias("accuracy"),
        F.round(F.col("_tp") / F.nullif(F.col("_pos"), F.lit(0)), 6).alias("rejected_recall"))


def retrain_triggers(metrics: DataFrame, trained_on: Column, max_psi: Column | None = None) -> DataFrame:
    """Per metrics row, the reasons to retrain (array) and a flag.

    ``trained_on`` is a date Column (e.g. a scalar subquery of the last
    training date); ``max_psi`` an optional scalar Column from a drift report.
    """
    reasons = [
        F.when(F.col("accuracy") < S.RETRAIN_MIN_ACCURACY, F.lit("accuracy_below_threshold")),
        F.when(F.col("rejected_recall") < S.RETRAIN_MIN_REJECTED_RECALL,
               F.lit("rejected_recall_below_threshold")),
        F.when(F.add_months(trained_on, S.RETRAIN_MAX_AGE_MONTHS) <= F.to_date("week_end"),
               F.lit("model_older_than_6_months")),
    ]
    if max_psi is not None:
        reasons.append(F.when(max_psi > S.RETRAIN_MAX_PSI, F.lit("psi_above_threshold")))
    arr = F.array_compact(F.array(*reasons))
    return metrics.select("week_start", "week_end", F.concat_ws(";", arr).alias("reasons"),
                          (F.size(arr) > 0).alias("retrain"))


def training_pull(master: DataFrame, months: int = S.RETRAIN_MAX_AGE_MONTHS) -> DataFrame:
    """Rows of the latest ``months`` months (by visit_date), no Pending claims, all rules passed."""
    latest = master.agg(F.max("visit_date")).scalar()
    cols = set(master.columns)
    failing = [F.coalesce(_RULE_EXPR[(r.table, r.name)](), F.lit(False))
               for r in RULES if set(r.columns) <= cols]
    bad = failing[0]
    for f in failing[1:]:
        bad = bad | f
    keep = ((F.col("visit_date") > F.add_months(latest, -months))
            & F.coalesce(F.col("claim_status") != "Pending", F.lit(True)) & ~bad)
    return master.where(keep)


def promotion_gate(active: DataFrame, candidate: DataFrame, keys: list[str], actual: str,
                   pred: str, tolerance: float = S.PROMOTION_TOLERANCE) -> DataFrame:
    """Compare two prediction sets on the rows both scored (null-safe equi-join on ``keys``: a visit without a bill
    has a NULL bill_id)."""
    a = active.select(*keys, F.col(actual).alias("_y"), F.col(pred).alias("_pa"))
    c = candidate.select(*keys, F.col(pred).alias("_pc"))
    both = null_safe_join(a, c, keys)
    agg = both.agg(F.count(F.lit(1)).alias("rows"),
                   (F.count_if(F.col("_y") == F.col("_pa")) / F.count(F.lit(1))).alias("active_accuracy"),
                   (F.count_if(F.col("_y") == F.col("_pc")) / F.count(F.lit(1))).alias("candidate_accuracy"))
    return agg.select("rows", F.round("active_accuracy", 6).alias("active_accuracy"),
                      F.round("candidate_accuracy", 6).alias("candidate_accuracy"),
                      (F.col("candidate_accuracy") >= F.col("active_accuracy") - tolerance).alias("promote"))
