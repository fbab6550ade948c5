"""Weekly audit metrics over streams of predictions (W1, streaming form).

Event time is the prediction timestamp; a watermark bounds the state, and
each 7-day window is emitted once, when the watermark passes its end
(append mode).  Late rows beyond the watermark are dropped by design.

Two forms: over rows that already carry the outcome, and over predictions and
outcomes that arrive by themselves, joined by key when the outcome comes within
a bound after the prediction.  Windows and dates are those of UTC, whatever
the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

LABELLED = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("actual", T.IntegerType()),
    T.StructField("predicted", T.IntegerType()),
])
PREDICTED = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("predicted", T.IntegerType()),
])
OUTCOME = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("outcome_ts", T.TimestampType()),
    T.StructField("actual", T.IntegerType()),
])


def utc_date(ts: Column) -> Column:
    """The UTC date of an instant, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def utc_midnight(date: Column) -> Column:
    """The instant at which a date begins in UTC, whatever the session's time zone."""
    return F.timestamp_seconds(F.unix_date(date).cast("long") * 86400)


def _weekly(rows: DataFrame, positive: int) -> DataFrame:
    agg = (rows.groupBy(F.window("ts", "7 days").alias("w"))
           .agg(F.count(F.lit(1)).alias("volume"),
                F.count_if(F.col("actual") == F.col("predicted")).alias("hits"),
                F.count_if(F.col("actual") == positive).alias("pos"),
                F.count_if((F.col("actual") == positive) & (F.col("predicted") == positive)).alias("tp")))
    return agg.select(utc_date(F.col("w.start")).alias("week_start"), utc_date(F.col("w.end")).alias("week_end"),
                      "volume", F.round(F.col("hits") / F.col("volume"), 6).alias("accuracy"),
                      F.round(F.col("tp") / F.nullif(F.col("pos"), F.lit(0)), 6).alias("rejected_recall"))


def _start(out: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    return (out.writeStream.outputMode("append").format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def weekly_metrics_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                          watermark: str = "14 days", positive: int = 2) -> StreamingQuery:
    """Weekly metrics of rows that carry prediction and outcome (LABELLED files)."""
    rows = spark.readStream.schema(LABELLED).parquet(source_dir).withWatermark("ts", watermark)
    return _start(_weekly(rows, positive), out_dir, checkpoint)


def weekly_outcomes_stream(spark: SparkSession, predictions_dir: str, outcomes_dir: str, out_dir: str, checkpoint: str,
                           bound: str = "60 days", watermark: str = "14 days", positive: int = 2) -> StreamingQuery:
    """Weekly metrics of predictions (PREDICTED files) joined to outcomes (OUTCOME files) that come later.

    An outcome counts if it comes at the time of the prediction or up to
    ``bound`` after it; later ones never meet their prediction.  Both sides have a
    watermark, so the state of the join is bounded by ``bound`` plus ``watermark``.
    """
    made = spark.readStream.schema(PREDICTED).parquet(predictions_dir).withWatermark("ts", watermark)
    known = (spark.readStream.schema(OUTCOME).parquet(outcomes_dir).withColumnRenamed("key", "outcome_key")
             .withWatermark("outcome_ts", watermark))
    both = made.join(known, (F.col("key") == F.col("outcome_key")) & (F.col("outcome_ts") >= F.col("ts"))
                     & (F.col("outcome_ts") <= F.col("ts") + F.expr(f"INTERVAL {bound}")))
    return _start(_weekly(both, positive), out_dir, checkpoint)


def late_outcomes(predictions: DataFrame, outcomes: DataFrame, bound: str = "60 days") -> DataFrame:
    """Outcomes later than ``bound`` after their prediction, counted by the prediction's week: (week_start, late)."""
    both = predictions.join(outcomes.withColumnRenamed("key", "outcome_key"), F.col("key") == F.col("outcome_key"))
    late = both.where(F.col("outcome_ts") > F.col("ts") + F.expr(f"INTERVAL {bound}"))
    return late.groupBy(F.window("ts", "7 days").alias("w")).agg(F.count(F.lit(1)).alias("late")).select(
        utc_date(F.col("w.start")).alias("week_start"), "late")
