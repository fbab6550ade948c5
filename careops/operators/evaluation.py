"""Evaluation of 3-class predictions (V2-V7).

Inputs are DataFrames with an actual and a predicted label column (encoded
0/1/2).  Everything starts from ``groupBy(actual, predicted).count()`` --
map-side partial counts, at most 9 rows per segment after the shuffle -- so
the metrics cost one pass over the scored rows whatever their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careops import schema as S
from careops.session import cut_lineage

DIGITS = 6


def encode(col: str, classes: Sequence[str]) -> Column:
    """M1: fixed-order label encoding (index in ``classes``); unknown / NULL -> NULL."""
    expr = None
    for i, c in enumerate(classes):
        expr = (F.when(F.col(col) == c, F.lit(i)) if expr is None
                else expr.when(F.col(col) == c, F.lit(i)))
    return expr


def with_targets(df: DataFrame) -> DataFrame:
    """M1: drop rows missing either target; add risk_label and claim_label."""
    return (df.where(F.col("risk_score").isNotNull() & F.col("claim_status").isNotNull())
            .withColumn("risk_label", encode("risk_score", S.RISK_CLASSES))
            .withColumn("claim_label", encode("claim_status", S.CLAIM_CLASSES)))


def rule_baseline(df: DataFrame) -> DataFrame:
    """Transparent rule predictions used as a checkable stand-in for a model.

    risk: stay >= 40 h High, >= 20 h Medium, else Low;
    claim: High risk Rejected, ER visit Pending, else Paid.
    """
    los = F.col("length_of_stay_hours")
    risk = F.when(los >= 40, 2).when(los >= 20, 1).otherwise(0)
    claim = F.when(F.col("risk_score") == "High", 2).when(F.col("visit_type") == "ER", 1).otherwise(0)
    return df.withColumn("risk_pred", risk).withColumn("claim_pred", claim)


class RuleModel:
    """A rule of :func:`rule_baseline` (``risk_pred`` or ``claim_pred``) as a model: its class has probability 1."""

    def __init__(self, rule: str, classes: int):
        self.rule, self.classes = rule, classes

    def transform(self, df: DataFrame) -> DataFrame:
        needed = [c for c in ("length_of_stay_hours", "risk_score", "visit_type") if c not in df.columns]
        ruled = rule_baseline(df.withColumns({c: F.lit(None) for c in needed})).select(*df.columns, self.rule)
        shares = F.array(*[(F.col(self.rule) == i).cast("double") for i in range(self.classes)])
        return (ruled.withColumn("probability", array_to_vector(shares))
                .withColumn("prediction", F.col(self.rule).cast("double")).drop(self.rule))


def confusion_counts(df: DataFrame, actual: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def _class_stats(conf: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (segment, class): tp, support (actual count), predicted count."""
    as_actual = conf.select(*by, F.col("actual").alias("label"),
                            F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"),
                            F.col("n").alias("support"), F.lit(0).cast("long").alias("pred_n"))
    as_pred = conf.select(*by, F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"),
                          F.lit(0).cast("long").alias("support"), F.col("n").alias("pred_n"))
    return as_actual.unionByName(as_pred).groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("pred_n").alias("pred_n"))


def _prf(stats: DataFrame) -> DataFrame:
    p = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    stats = stats.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return stats.withColumn("f1_score", f1)


def classification_report(df: DataFrame, actual: str, pred: str,
                          classes: Sequence[str]) -> DataFrame:
    """V2: per class precision / recall / F1 / support, then accuracy, macro and weighted avg."""
    # at most k x k rows, read by every branch below: computed once
    conf = cut_lineage(confusion_counts(df, actual, pred))
    stats = _prf(_class_stats(conf, []))
    names = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("label") + 1)
    per_class = stats.where(F.col("label").between(0, len(classes) - 1)).select(
        names.alias("label"), "precision", "recall", "f1_score", "support")
    total = F.sum("support")
    summary = per_class.agg(
        total.alias("support"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / total).alias("wf"))
    acc = stats.agg((F.sum("tp") / F.sum("support")).alias("acc"))
    rows = [
        summary.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                       F.lit(None).cast("double").alias("recall"), acc.scalar().alias("f1_score"),
                       "support"),
        summary.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), "support"),
        summary.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                       F.col("wr").alias("recall"), F.col("wf").alias("f1_score"), "support"),
    ]
    out = per_class
    for r in rows:
        out = out.unionByName(r)
    return out.select("label", *[F.round(c, DIGITS).alias(c) for c in ("precision", "recall", "f1_score")],
                      F.col("support").cast("long").alias("support"))


def confusion_matrix(df: DataFrame, actual: str, pred: str, classes: Sequence[str],
                     normalize: bool = False) -> DataFrame:
    """V3 (counts, zeros filled) or V4 (row-normalized, empty row -> NULL): one row per actual class."""
    conf = cut_lineage(confusion_counts(df, actual, pred))
    k = len(classes)
    grid = conf.agg(F.count(F.lit(1)).alias("_c")).select(
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("actual"))
    wide = conf.groupBy("actual").pivot("predicted", list(range(k))).agg(F.sum("n"))
    wide = grid.join(wide, "actual", "left").fillna(0, [str(i) for i in range(k)])
    names = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("actual") + 1)
    row_sum = sum((F.col(f"`{i}`") for i in range(k)), F.lit(0))
    if normalize:
        cells = [F.round(F.col(f"`{i}`") / F.nullif(row_sum, F.lit(0)), DIGITS).alias(f"pred_{c}")
                 for i, c in enumerate(classes)]
    else:
        cells = [F.col(f"`{i}`").cast("long").alias(f"pred_{c}") for i, c in enumerate(classes)]
    return wide.select(names.alias("actual"), *cells)


def class_recall(df: DataFrame, actual: str, pred: str, label: int) -> Column:
    """Recall of one class as a scalar subquery column (V4 cell [label, label])."""
    return df.agg((F.count_if((F.col(actual) == label) & (F.col(pred) == label))
                   / F.nullif(F.count_if(F.col(actual) == label), F.lit(0)))).scalar()


def revenue_protection(df: DataFrame, actual: str = "claim_label", pred: str = "claim_pred",
                       amount: str = "billed_amount", rejected: int = 2) -> DataFrame:
    """V5: billed amount of actually Rejected claims, the part predicted Rejected, and its %."""
    is_rej = F.col(actual) == rejected
    zero = F.lit(0).cast("decimal(10,2)")
    agg = df.agg(
        F.coalesce(F.sum(F.when(is_rej, F.col(amount))), zero).alias("total_rejected_billed"),
        F.coalesce(F.sum(F.when(is_rej & (F.col(pred) == rejected), F.col(amount))), zero)
        .alias("flagged_rejected_billed"))
    return agg.select(
        F.col("total_rejected_billed").cast("double").alias("total_rejected_billed"),
        F.col("flagged_rejected_billed").cast("double").alias("flagged_rejected_billed"),
        F.round(F.col("flagged_rejected_billed").cast("double") * 100
                / F.nullif(F.col("total_rejected_billed").cast("double"), F.lit(0.0)), 4)
        .alias("flagged_pct"))


def fairness(df: DataFrame, actual: str, pred: str, segments: Sequence[str],
             positive: int = 2) -> DataFrame:
    """V7: per segment value volume, accuracy, weighted F1 and recall of ``positive`` (NULL if absent).

    All segment columns in one pass: rows are unpivoted to (segment, value),
    NULL segment values dropped, and a single two-level aggregation follows.
    """
    long = df.select(F.col(actual).alias("_a"), F.col(pred).alias("_p"), F.inline(F.array(*[
        F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("segment_value"))
        for s in segments]))).where(F.col("segment_value").isNotNull())
    conf = confusion_counts(long, "_a", "_p", ["segment", "segment_value"])
    stats = _prf(_class_stats(conf, ["segment", "segment_value"]))
    agg = stats.groupBy("segment", "segment_value").agg(
        F.sum("support").alias("volume"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.max(F.when((F.col("label") == positive) & (F.col("support") > 0), F.col("recall")))
        .alias("positive_recall"))
    return agg.where(F.col("volume") > 0).select(
        "segment", "segment_value", F.col("volume").cast("long").alias("volume"),
        *[F.round(c, DIGITS).alias(c) for c in ("accuracy", "weighted_f1", "positive_recall")])
