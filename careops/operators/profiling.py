"""Profiling of the master frame.

Percentiles are exact and linear-interpolated (numpy / SQL quantile_cont),
computed with the distributed rank machinery in ``careops.functions.ranks``;
several columns are handled in one pass by unpivoting them to
(column, value) and grouping by column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careops.functions.joins import lookup_join
from careops.functions.ranks import cumulative_counts, exact_percentiles, percentiles_of

OUTLIER_COLUMNS = ["billed_amount", "payment_days", "length_of_stay_hours"]
CATEGORY_COLUMNS = ["department", "visit_type", "insurance_provider", "city"]


def missing_summary(df: DataFrame) -> DataFrame:
    """Per column missing count and percentage (half-even, 2 places); only columns with gaps."""
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = "stack({n}, {pairs}) AS (column_name, missing_count)".format(
        n=len(cols), pairs=", ".join(f"'{c}', `{c}`" for c in cols))
    long = counts.selectExpr("_n", stack)
    return long.where("missing_count > 0").select(
        "column_name", "missing_count",
        F.bround(F.col("missing_count") * 100 / F.col("_n"), 2).alias("missing_pct"))


def unpivot_values(df: DataFrame, columns: Sequence[str], cast: str | None = None,
                   name: str = "column_name", value: str = "value") -> DataFrame:
    """Long (column_name, value) form of ``columns``; one row per input row and column."""
    def v(c):
        return F.col(c).cast(cast) if cast else F.col(c)
    arr = F.array(*[F.struct(F.lit(c).alias(name), v(c).alias(value)) for c in columns])
    return df.select(F.inline(arr))


def category_counts(df: DataFrame, columns: Sequence[str] = CATEGORY_COLUMNS) -> DataFrame:
    """Visit counts per value of each categorical column, NULL excluded (one shuffle)."""
    long = unpivot_values(df, columns, "string", "dimension", "value").where(F.col("value").isNotNull())
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("visit_count"))


_QUARTILE_NAMES = {0.25: "q1", 0.5: "median", 0.75: "q3"}


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n, cum_n): the distinct values of all columns, computed once."""
    long = unpivot_values(df, columns, "double").where(F.col("value").isNotNull())
    return cumulative_counts(long, "value", None, ["column_name"])


def _quartiles(counts: DataFrame, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column_name with q1 / median / q3 columns (those asked for)."""
    q = percentiles_of(counts, "value", list(probs), ["column_name"])
    return q.groupBy("column_name").agg(*[
        F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(_QUARTILE_NAMES[p]) for p in probs])


def iqr_outliers(df: DataFrame, columns: Sequence[str] = OUTLIER_COLUMNS) -> DataFrame:
    """IQR bounds q1 - 1.5 iqr, q3 + 1.5 iqr; count of values strictly outside; % of non-NULL."""
    counts = _value_counts(df, columns)
    q = _quartiles(counts, (0.25, 0.75))
    bounds = q.select("column_name",
                      (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
                      (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper_bound"))
    tagged = counts.join(bounds, "column_name")
    out = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    agg = tagged.groupBy("column_name", "lower_bound", "upper_bound").agg(
        F.sum(F.when(out, F.col("n")).otherwise(0)).alias("outlier_count"), F.sum("n").alias("non_null_count"))
    return agg.select(
        "column_name", "outlier_count", "non_null_count",
        F.round("lower_bound", 6).alias("lower_bound"), F.round("upper_bound", 6).alias("upper_bound"),
        F.bround(F.col("outlier_count") * 100 / F.col("non_null_count"), 2).alias("outlier_pct"))


def box_summary(df: DataFrame, columns: Sequence[str] = OUTLIER_COLUMNS) -> DataFrame:
    """q1, median, q3 and whiskers (most extreme values inside the 1.5 IQR bounds)."""
    counts = _value_counts(df, columns)
    tagged = counts.join(_quartiles(counts), "column_name")
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    agg = tagged.groupBy("column_name", "q1", "median", "q3").agg(
        F.min(F.when(F.col("value") >= lo, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(F.col("value") <= hi, F.col("value"))).alias("upper_whisker"))
    return agg.select("column_name", *[F.round(c, 6).alias(c) for c in
                                       ("q1", "median", "q3", "lower_whisker", "upper_whisker")])


def impute(df: DataFrame, group: str = "department", stay: str = "length_of_stay_hours") -> DataFrame:
    """E5 (opt-in): stay <- its group median; approved_amount and payment_days <- 0 when missing.

    Rows without a group keep a missing stay: they are no group to take a median of.
    """
    med = exact_percentiles(df.where(F.col(group).isNotNull()), stay, [0.5], [group]).select(group, F.col("value").alias("_median"))
    out = lookup_join(df, med, group)
    return out.select(
        *[c for c in df.columns if c not in (stay, "approved_amount", "payment_days")],
        F.coalesce(F.col(stay).cast("double"), F.col("_median")).alias(stay),
        F.coalesce(F.col("approved_amount"), F.lit(0).cast("decimal(10,2)")).alias("approved_amount"),
        F.coalesce(F.col("payment_days"), F.lit(0)).alias("payment_days"),
    ).select(*df.columns)
