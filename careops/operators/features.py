"""Time-based split and leakage-controlled features.

* ``time_split`` (F1): the first floor(0.8 n) rows in (visit_date, visit_id,
  bill_id) order are train.  Instead of a global ``row_number`` (one task),
  the k-th smallest key is found with distributed rank passes and every row
  is then tagged by a plain lexicographic comparison with that key.
* ``fit_aggregates`` (F2-F5): provider rejection and department realization
  rates from the train rows only, plus the two global fallbacks.
* ``transform_features`` (F6-F11): per split, patient-level counts and
  means are aggregated and joined back (a hot patient is collapsed by the
  partial aggregate and split by AQE's skew join, never windowed in one
  task); fitted rates and frame means are lookup tables sent to the rows.
* ``current_aggregates`` (F13): the scoring-time rates over all data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careops import schema as S
from careops.functions.joins import lookup_join, spread
from careops.functions.ranks import kth_key, lex_leq
from careops.session import cut_lineage

_NULL_DATE_KEY = 2_147_483_647          # NULL visit dates sort last
_NULL_BILL_KEY = -9_223_372_036_854_775_808  # visits without a bill sort first among ties


def split_keys(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.unix_date("visit_date"), F.lit(_NULL_DATE_KEY)).cast("long"),
            F.col("visit_id").cast("long"),
            F.coalesce(F.col("bill_id").cast("long"), F.lit(_NULL_BILL_KEY))]


def time_split(master: DataFrame, train_num: int = 4, train_den: int = 5,
               buckets: int | None = None) -> DataFrame:
    """add ``split`` ('train' / 'test'); train = first floor(n*num/den) rows by key.

    The rows are checkpointed first, so that finding the bound and tagging them
    read one result of the three-table join: select the columns that are needed.
    """
    master = cut_lineage(master)
    keyed = master.select(*[k.alias(f"_k{i}") for i, k in enumerate(split_keys(master))])
    bound = kth_key(keyed, ["_k0", "_k1", "_k2"], keyed.count() * train_num // train_den, buckets)
    if bound is None:
        return master.withColumn("split", F.lit("test"))
    is_train = lex_leq(split_keys(master), bound)
    return master.withColumn("split", F.when(is_train, "train").otherwise("test"))


@dataclass
class Aggregates:
    """Fitted lookup tables (small, keyed DataFrames) and global fallbacks."""
    provider_rejection: DataFrame   # insurance_provider, provider_rejection_rate
    dept_realization: DataFrame     # department, revenue_realization_rate_dept
    globals: DataFrame              # one row: global_rejection, global_realization


def _safe_div(num: Column, den: Column) -> Column:
    """num / den with a zero denominator replaced by 1, as DOUBLE."""
    return num.cast("double") / F.when(den == 0, F.lit(1)).otherwise(den).cast("double")


def fit_aggregates(train: DataFrame) -> Aggregates:
    """F2-F5 from the train rows only."""
    rejected = F.when(F.col("claim_status") == "Rejected", 1).otherwise(0)
    prov = (train.where(F.col("insurance_provider").isNotNull())
            .groupBy("insurance_provider")
            .agg(F.count("claim_status").alias("_tot"), F.sum(rejected).alias("_rej"))
            .select("insurance_provider",
                    _safe_div(F.col("_rej"), F.col("_tot")).alias("provider_rejection_rate")))
    dept = (train.where(F.col("department").isNotNull())
            .groupBy("department")
            .agg(F.coalesce(F.sum("billed_amount"), F.lit(0)).alias("_b"),
                 F.coalesce(F.sum("approved_amount"), F.lit(0)).alias("_a"))
            .select("department", _safe_div(F.col("_a"), F.col("_b"))
                    .alias("revenue_realization_rate_dept")))
    billed_no_zero = F.when(F.col("billed_amount") == 0, F.lit(1).cast("decimal(10,2)")) \
        .otherwise(F.col("billed_amount"))
    glob = train.agg(
        (F.sum(rejected).cast("double") / F.count(F.lit(1))).alias("global_rejection"),
        (F.coalesce(F.sum("approved_amount"), F.lit(0)).cast("double")
         / F.sum(billed_no_zero).cast("double")).alias("global_realization"))
    return Aggregates(prov, dept, glob)


def current_aggregates(patients: DataFrame, visits: DataFrame, billing: DataFrame) -> Aggregates:
    """rates over all data as the scoring service loads them.

    Provider groups keep NULL providers and count bill_id; the globals are
    sums of the per-group numerators over sums of per-group denominators
    (a zero denominator counted as 1 per group).
    """
    vb = billing.join(visits.select("visit_id", "patient_id", "department"), "visit_id")
    per_patient = vb.groupBy("patient_id").agg(
        F.count("bill_id").alias("_tot"),
        F.sum(F.when(F.col("claim_status") == "Rejected", 1).otherwise(0)).alias("_rej"))
    # the per-group tables feed both the rates and the globals: computed once
    prov_counts = cut_lineage(
        patients.select("patient_id", "insurance_provider").join(per_patient, "patient_id")
        .groupBy("insurance_provider").agg(F.sum("_tot").alias("_tot"), F.sum("_rej").alias("_rej")))
    prov = prov_counts.select("insurance_provider",
                              _safe_div(F.col("_rej"), F.col("_tot")).alias("provider_rejection_rate"))
    dept_sums = cut_lineage(vb.groupBy("department").agg(F.sum("billed_amount").alias("_b"),
                                                         F.sum("approved_amount").alias("_a")))
    dept = dept_sums.select("department", (F.col("_a").cast("double") / F.when(
        F.col("_b") == 0, F.lit(1)).otherwise(F.col("_b")).cast("double"))
        .alias("revenue_realization_rate_dept"))
    g_prov = prov_counts.agg(
        (F.sum("_rej").cast("double")
         / F.sum(F.when(F.col("_tot") == 0, 1).otherwise(F.col("_tot"))).cast("double"))
        .alias("global_rejection"))
    g_dept = dept_sums.agg(
        (F.sum("_a").cast("double")
         / F.sum(F.when(F.col("_b") == 0, F.lit(1)).otherwise(F.col("_b"))).cast("double"))
        .alias("global_realization"))
    glob = g_prov.select("global_rejection", g_dept.scalar().alias("global_realization"))
    return Aggregates(prov, dept, glob)


def _per_split_patient_stats(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    los = F.col("length_of_stay_hours")
    per_patient = df.where(F.col("patient_id").isNotNull()).groupBy(*by, "patient_id").agg(
        F.count("visit_id").alias("visit_frequency"),
        (F.sum(los).cast("double") / F.nullif(F.count(los), F.lit(0))).alias("_pat_avg"))
    frame_mean = df.groupBy(*by).agg(
        (F.sum(los).cast("double") / F.nullif(F.count(los), F.lit(0))).alias("_frame_avg"))
    return per_patient, frame_mean


def transform_features(df: DataFrame, aggregates: Aggregates | None = None,
                       by: list[str] | None = None, rows: int = 0) -> DataFrame:
    """F6-F11 on ``df``; patient-level features are computed within each ``by`` frame.

    With ``aggregates`` (F10) rates are mapped and unseen keys fall back to the
    globals; without (F11) rates come from the frame itself, missing -> 0.0.
    ``rows`` (of ``df``, if known) deals a large frame to more tasks than the session's shuffle partitions.
    """
    by = list(by or [])
    out = df.withColumn(
        "days_since_registration",
        F.when(F.datediff("visit_date", "registration_date").isNotNull(),
               F.greatest(F.datediff("visit_date", "registration_date"), F.lit(0)))
    ).withColumn("visit_month", F.month("visit_date")) \
     .withColumn("visit_day_of_week", F.weekday("visit_date"))

    per_patient, frame_mean = _per_split_patient_stats(out, by)
    # the patients are dealt by the number of rows, and the rows come to them
    out = out.join(spread(per_patient, rows, [*by, "patient_id"]), [*by, "patient_id"], "left")
    out = lookup_join(out, frame_mean, by) if by else \
        out.withColumn("_frame_avg", frame_mean.select("_frame_avg").scalar())
    out = out.withColumn("avg_length_of_stay_patient", F.coalesce("_pat_avg", "_frame_avg"))

    if aggregates is not None:
        out = lookup_join(out, aggregates.provider_rejection, "insurance_provider")
        out = lookup_join(out, aggregates.dept_realization, "department")
        g = aggregates.globals
        out = out.withColumn("provider_rejection_rate", F.coalesce(
            "provider_rejection_rate", g.select("global_rejection").scalar())) \
            .withColumn("revenue_realization_rate_dept", F.coalesce(
                "revenue_realization_rate_dept", g.select("global_realization").scalar()))
    else:
        rej = (F.col("claim_status") == "Rejected").cast("int")
        prov = (out.where(F.col("insurance_provider").isNotNull())
                .groupBy(*by, "insurance_provider")
                .agg((F.coalesce(F.sum(rej), F.lit(0)).cast("double") / F.count(F.lit(1)))
                     .alias("provider_rejection_rate")))
        dept = (out.where(F.col("department").isNotNull()).groupBy(*by, "department")
                .agg(_safe_div(F.coalesce(F.sum("approved_amount"), F.lit(0)),
                               F.coalesce(F.sum("billed_amount"), F.lit(0)))
                     .alias("revenue_realization_rate_dept")))
        out = lookup_join(out, prov, [*by, "insurance_provider"])
        out = lookup_join(out, dept, [*by, "department"])
        out = out.fillna(0.0, ["provider_rejection_rate", "revenue_realization_rate_dept"])
    return out.select(*df.columns, *S.ENGINEERED_COLUMNS)


def model_table(master: DataFrame, buckets: int | None = None) -> DataFrame:
    """Master + split + features, aggregates fitted on train and applied to both splits."""
    split = time_split(master.select(*S.MASTER_COLUMNS), buckets=buckets)
    aggs = fit_aggregates(split.where(F.col("split") == "train"))
    feats = transform_features(split, aggs, by=["split"], rows=split.count())
    return feats.select(*S.MASTER_COLUMNS, *S.ENGINEERED_COLUMNS, "split")


def aggregates_long(aggs: Aggregates) -> DataFrame:
    """Fitted aggregates as one (kind, key, rate) table."""
    g = aggs.globals
    return (aggs.provider_rejection.select(F.lit("provider_rejection").alias("kind"),
                                           F.col("insurance_provider").alias("key"),
                                           F.col("provider_rejection_rate").alias("rate"))
            .unionByName(aggs.dept_realization.select(F.lit("dept_realization").alias("kind"),
                                                      F.col("department").alias("key"),
                                                      F.col("revenue_realization_rate_dept").alias("rate")))
            .unionByName(g.select(F.lit("global_rejection").alias("kind"),
                                  F.lit(None).cast("string").alias("key"),
                                  F.col("global_rejection").alias("rate")))
            .unionByName(g.select(F.lit("global_realization").alias("kind"),
                                  F.lit(None).cast("string").alias("key"),
                                  F.col("global_realization").alias("rate"))))


def causal_visit_frequency(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F8 option ``causal``: per row, the patient's rows on or before its visit date (within ``by``).

    The default F8 counts every row of the patient in the frame, future ones
    included; this variant only looks back.  It uses distributed cumulative
    counts grouped by (frame, patient) over visit dates, so a patient with a
    huge history is spread over date buckets instead of one window task.
    """
    from careops.functions.ranks import cumulative_counts
    by = list(by or [])
    keyed = df.where(F.col("patient_id").isNotNull() & F.col("visit_date").isNotNull()) \
        .select(*by, "patient_id", F.unix_date("visit_date").alias("_day"),
                F.when(F.col("visit_id").isNotNull(), 1).otherwise(0).alias("_has_visit"))
    cum = cumulative_counts(keyed, "_day", {"_n": F.col("_has_visit")}, [*by, "patient_id"])
    per_day = cum.select(*by, "patient_id", "_day", F.col("cum__n").alias("visit_frequency_causal"))
    return df.withColumn("_day", F.unix_date("visit_date")).join(
        per_day, [*by, "patient_id", "_day"], "left").drop("_day")
