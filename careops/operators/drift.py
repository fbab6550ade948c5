"""Drift statistics between a reference and a production frame (K1-K5).

* K1: two-sample Kolmogorov-Smirnov D from exact cumulative counts (see
  ``careops.functions.ranks``), p-value exact for small samples and by an
  expansion for large ones, evaluated as a Spark expression.
* K2: categorical PSI = sum (a - e) ln(a / e) over the union of categories,
  a category missing on one side takes share 0.0001.
* K3: numeric PSI over 10 reference-percentile bins (deduplicated edges,
  bins [a, b) with the last one closed, out-of-range production values
  dropped from the bins but kept in the denominator, +0.5 smoothing).
  Fewer than 5 distinct reference values falls back to K2.
* K4: status rules; K5: the 9-row report.

Every statistic is a Spark aggregate; only the 11 bin edges and a
distinct-count probe come back to the driver as scalars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops import schema as S
from careops.functions.ranks import (bucket_of, cumulative_counts, ks_pvalue, ks_statistic,
                                     percentile_values, percentiles_of)
from careops.session import cut_lineage

REPORT_SCHEMA = ("MetricType string, Feature string, Method string, Statistic double, "
                 "PValue double, PSI double, DriftDetected int, DriftStatus string")


def ks_test(ref: DataFrame, prod: DataFrame, col: str) -> DataFrame:
    """K1: one row (d, n_ref, n_prod, p_value); NULLs dropped."""
    ks = ks_statistic(ref, prod, col)
    return ks.withColumn("p_value", ks_pvalue(F.col("d"), F.col("n_ref"), F.col("n_prod")))


def psi_categorical(ref: DataFrame, prod: DataFrame, col: str) -> DataFrame:
    """K2: one row (psi)."""
    def shares(df, name):
        vals = df.select(F.col(col).alias("_c")).where(F.col("_c").isNotNull())
        total = vals.agg(F.count(F.lit(1))).scalar()
        return vals.groupBy("_c").agg((F.count(F.lit(1)) / total).alias(name))
    both = shares(ref, "_e").join(shares(prod, "_a"), "_c", "full_outer")
    e = F.coalesce("_e", F.lit(S.PSI_MISSING_SHARE))
    a = F.coalesce("_a", F.lit(S.PSI_MISSING_SHARE))
    return both.agg(F.coalesce(F.sum((a - e) * F.log(a / e)), F.lit(0.0)).alias("psi"))


def psi_numeric(ref: DataFrame, prod: DataFrame, col: str, bins: int = S.PSI_BINS) -> DataFrame:
    """K3: one row (psi) over reference-percentile bins."""
    r = ref.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    p = prod.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    edges = sorted(set(v for v in percentile_values(r, "_v", [i / bins for i in range(bins + 1)])
                       if v is not None))
    if len(edges) < 2:
        return r.agg(F.lit(0.0).alias("psi"))
    nb = len(edges) - 1
    inner = edges[1:-1]

    def counts(df, name):
        in_range = df.where((F.col("_v") >= edges[0]) & (F.col("_v") <= edges[-1]))
        return in_range.groupBy(bucket_of_leq(F.col("_v"), inner).alias("_bin")).agg(
            F.count(F.lit(1)).alias(name))

    n_ref = r.agg(F.count(F.lit(1))).scalar()
    n_prod = p.agg(F.count(F.lit(1))).scalar()
    grid = r.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))
                                                         .alias("_bin"))
    full = grid.join(counts(r, "_cr"), "_bin", "left").join(counts(p, "_cp"), "_bin", "left")
    e = (F.coalesce("_cr", F.lit(0)) + 0.5) / (n_ref + 0.5 * nb)
    a = (F.coalesce("_cp", F.lit(0)) + 0.5) / (n_prod + 0.5 * nb)
    return full.agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def bucket_of_leq(value, inner_edges: Sequence[float]):
    """Bin index = number of inner edges <= value (histogram bins [a, b), last closed)."""
    return bucket_of(value, [float(e) for e in inner_edges], strict=False)


def _is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.NumericType)


def psi(ref: DataFrame, prod: DataFrame, col: str) -> DataFrame:
    """K2 or K3 by the reference column's type and number of distinct values."""
    if not _is_numeric(ref, col):
        return psi_categorical(ref, prod, col)
    few = (ref.select(col).where(F.col(col).isNotNull()).distinct()
           .limit(S.PSI_MIN_DISTINCT).count() < S.PSI_MIN_DISTINCT)
    return psi_categorical(ref, prod, col) if few else psi_numeric(ref, prod, col)


def numeric_row(ref: DataFrame, prod: DataFrame, col: str) -> DataFrame:
    ks = ks_test(ref, prod, col)
    ps = psi(ref, prod, col).scalar()
    detected = F.col("p_value") < S.KS_ALPHA
    return ks.select(
        F.lit("Feature_Numeric").alias("MetricType"), F.lit(col).alias("Feature"),
        F.lit("Kolmogorov-Smirnov").alias("Method"),
        F.bround("d", 4).alias("Statistic"), F.bround("p_value", 6).alias("PValue"),
        F.bround(ps, 4).alias("PSI"), detected.cast("int").alias("DriftDetected"),
        F.when(detected, "Drift Detected").otherwise("Stable").alias("DriftStatus"))


def psi_status(value_col):
    """K4: PSI >= 0.25 significant (flag 1); >= 0.1 moderate warning (flag 0); else stable."""
    status = (F.when(value_col >= S.PSI_SIGNIFICANT, "Significant Drift")
              .when(value_col >= S.PSI_MODERATE, "Moderate Drift (Warning)").otherwise("Stable"))
    flag = F.when(value_col >= S.PSI_SIGNIFICANT, 1).otherwise(0)
    return status, flag


def categorical_row(ref: DataFrame, prod: DataFrame, col: str) -> DataFrame:
    ps = psi(ref, prod, col)
    status, flag = psi_status(F.col("psi"))
    return ps.select(
        F.lit("Feature_Categorical").alias("MetricType"), F.lit(col).alias("Feature"),
        F.lit("Population Stability Index").alias("Method"),
        F.bround("psi", 4).alias("Statistic"), F.lit(None).cast("double").alias("PValue"),
        F.bround("psi", 4).alias("PSI"), flag.alias("DriftDetected"), status.alias("DriftStatus"))


def _long(ref: DataFrame, prod: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    """(feature, _v, _a, _b): every non-NULL value of ``cols``, tagged reference (_a) or production (_b)."""
    def side(df, a, b):
        arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(cast).alias("_v")) for c in cols])
        return df.select(F.inline(arr)).where(F.col("_v").isNotNull()).select(
            "feature", "_v", F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    return side(ref, 1, 0).unionByName(side(prod, 0, 1))


def _categorical_psi(long: DataFrame) -> DataFrame:
    """K2 for every feature of ``long`` in one aggregation: (feature, psi)."""
    counts = long.groupBy("feature", "_v").agg(F.sum("_a").alias("ca"), F.sum("_b").alias("cb"))
    totals = long.groupBy("feature").agg(F.sum("_a").alias("nr"), F.sum("_b").alias("np"))
    both = counts.join(totals, "feature")
    miss = F.lit(S.PSI_MISSING_SHARE)
    e = F.when(F.col("ca") > 0, F.col("ca") / F.col("nr")).otherwise(miss)
    a = F.when(F.col("cb") > 0, F.col("cb") / F.col("np")).otherwise(miss)
    return both.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def _numeric_psi(long: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """K3 for the features in ``edges`` (each with >= 2 distinct edges) in one aggregation."""
    feats = list(edges)
    sub = long.where(F.col("feature").isin(feats))
    lo = hi = binned = nb = None
    for f in feats:
        e = edges[f]
        is_f = F.col("feature") == f
        b = bucket_of(F.col("_v"), [float(x) for x in e[1:-1]], strict=False)
        binned = F.when(is_f, b) if binned is None else binned.when(is_f, b)
        lo = F.when(is_f, F.lit(e[0])) if lo is None else lo.when(is_f, F.lit(e[0]))
        hi = F.when(is_f, F.lit(e[-1])) if hi is None else hi.when(is_f, F.lit(e[-1]))
        nb = F.when(is_f, F.lit(len(e) - 1)) if nb is None else nb.when(is_f, F.lit(len(e) - 1))
    totals = sub.groupBy("feature").agg(F.sum("_a").alias("nr"), F.sum("_b").alias("np")) \
        .withColumn("nb", nb)
    counts = (sub.where((F.col("_v") >= lo) & (F.col("_v") <= hi))
              .groupBy("feature", binned.alias("bin")).agg(F.sum("_a").alias("cr"), F.sum("_b").alias("cp")))
    grid = totals.select("feature", "nr", "np", "nb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bin"))
    full = grid.join(counts, ["feature", "bin"], "left")
    e = (F.coalesce("cr", F.lit(0)) + 0.5) / (F.col("nr") + 0.5 * F.col("nb"))
    a = (F.coalesce("cp", F.lit(0)) + 0.5) / (F.col("np") + 0.5 * F.col("nb"))
    return full.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def drift_report(ref: DataFrame, prod: DataFrame,
                 numeric: Sequence[str] = S.DRIFT_NUMERIC,
                 categorical: Sequence[str] = S.DRIFT_CATEGORICAL) -> DataFrame:
    """K5: KS + PSI rows for numeric features, PSI rows for categoricals; missing columns skipped.

    All numeric features share one unpivoted pass: exact cumulative counts
    grouped by feature give every KS D at once, one grouped percentile pass
    gives every set of PSI edges, one aggregation every binned PSI.  All
    categorical features share one grouped count.  Only the bin edges and
    the per-feature distinct counts (a few scalars each) reach the driver.
    """
    shared = set(ref.columns) & set(prod.columns)
    num = [c for c in numeric if c in shared and _is_numeric(ref, c)]
    cat = [c for c in categorical if c in shared] + [c for c in numeric if c in shared and c not in num]
    spark = ref.sparkSession
    parts = []
    if num:
        # one row per (feature, value) with both sides' counts and running counts: all below reads it
        cum = cut_lineage(cumulative_counts(_long(ref, prod, num, "double"), "_v",
                                            {"na": F.col("_a"), "nb": F.col("_b")}, ["feature"]))
        long = cum.select("feature", "_v", F.col("na").alias("_a"), F.col("nb").alias("_b"))
        totals = cum.groupBy("feature").agg(F.sum("na").alias("n_ref"), F.sum("nb").alias("n_prod"),
                                            F.count_if(F.col("na") > 0).alias("ref_distinct"))
        gap = F.abs(F.col("cum_na") / F.col("n_ref") - F.col("cum_nb") / F.col("n_prod"))
        ks = cut_lineage(cum.join(totals, "feature").groupBy("feature", "n_ref", "n_prod", "ref_distinct")
                         .agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("d")))
        distinct = {r.feature: r.ref_distinct for r in ks.select("feature", "ref_distinct").collect()}
        binned = [f for f in num if distinct.get(f, 0) >= S.PSI_MIN_DISTINCT]
        few = [f for f in num if f not in binned]
        edges = {}
        if binned:
            probs = [i / S.PSI_BINS for i in range(S.PSI_BINS + 1)]
            q = percentiles_of(cum.where(F.col("feature").isin(binned)), "_v", probs, ["feature"], "na").collect()
            for f in binned:
                edges[f] = sorted({r.value for r in q if r.feature == f and r.value is not None})
        psi_parts = []
        with_edges = {f: e for f, e in edges.items() if len(e) >= 2}
        if with_edges:
            psi_parts.append(_numeric_psi(long, with_edges))
        flat = [f for f, e in edges.items() if len(e) < 2]
        if flat:
            psi_parts.append(ks.where(F.col("feature").isin(flat)).select("feature", F.lit(0.0).alias("psi")))
        if few:
            psi_parts.append(_categorical_psi(long.where(F.col("feature").isin(few))
                                              .withColumn("_v", F.col("_v").cast("string"))))
        psi_num = psi_parts[0]
        for extra in psi_parts[1:]:
            psi_num = psi_num.unionByName(extra)
        p = ks_pvalue(F.col("d"), F.col("n_ref"), F.col("n_prod"))
        rows = ks.join(psi_num, "feature").withColumn("p_value", p)
        detected = F.col("p_value") < S.KS_ALPHA
        parts.append(rows.select(
            F.lit("Feature_Numeric").alias("MetricType"), F.col("feature").alias("Feature"),
            F.lit("Kolmogorov-Smirnov").alias("Method"),
            F.bround("d", 4).alias("Statistic"), F.bround("p_value", 6).alias("PValue"),
            F.bround("psi", 4).alias("PSI"), detected.cast("int").alias("DriftDetected"),
            F.when(detected, "Drift Detected").otherwise("Stable").alias("DriftStatus")))
    if cat:
        long_c = _long(ref, prod, cat, "string")
        psi_c = _categorical_psi(long_c)
        status, flag = psi_status(F.col("psi"))
        parts.append(psi_c.select(
            F.lit("Feature_Categorical").alias("MetricType"), F.col("feature").alias("Feature"),
            F.lit("Population Stability Index").alias("Method"),
            F.bround("psi", 4).alias("Statistic"), F.lit(None).cast("double").alias("PValue"),
            F.bround("psi", 4).alias("PSI"), flag.alias("DriftDetected"), status.alias("DriftStatus")))
    if not parts:
        return spark.createDataFrame([], REPORT_SCHEMA)
    out = parts[0]
    for r in parts[1:]:
        out = out.unionByName(r)
    return out


def induce_drift(df: DataFrame, age_shift: int = -10, billed_factor: float = 1.15) -> DataFrame:
    """Test input only: a younger cohort and higher bills."""
    return df.withColumn("age", F.col("age") + age_shift).withColumn(
        "billed_amount", F.col("billed_amount").cast("double") * billed_factor)
