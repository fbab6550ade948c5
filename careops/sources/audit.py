"""Prediction audit trail.

Rows are appended per scoring batch under ``batch_id=<n>``; a batch that is
replayed (after a restart without its commit) overwrites its own partition
only (dynamic partition overwrite), so the trail holds no duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careops.operators.scoring import feature_hash, request_json

AUDIT_COLUMNS = ["batch_id", "row_id", "endpoint", "timestamp", "input_data", "prediction",
                 "model_version", "feature_hash"]


def audit_rows(scored: DataFrame, endpoint: str, batch_id: int, fields: Sequence[str] | None = None,
               prediction: str = "predicted_class", version: str = "model_version",
               keys: Sequence[str] = ()) -> DataFrame:
    """S8 rows: id = (batch_id, row_id), time of scoring, raw input as JSON, hash of the input.

    ``row_id`` is an md5 of the row's contents (and of the ``keys`` columns),
    so it doesn't depend on how the batch is partitioned.

    The JSON and hash come from ``input_data`` / ``feature_hash`` columns made
    before model preparation, or from ``fields`` when those are still present.
    """
    data = F.col("input_data") if fields is None else request_json(fields)
    digest = F.col("feature_hash") if fields is None else feature_hash(fields)
    return scored.select(
        F.lit(batch_id).cast("long").alias("batch_id"),
        F.md5(F.concat_ws(":", F.lit(endpoint), data, F.col(prediction), F.col(version), *keys)).alias("row_id"),
        F.lit(endpoint).alias("endpoint"),
        F.current_timestamp().alias("timestamp"),
        data.alias("input_data"),
        F.col(prediction).alias("prediction"),
        F.col(version).alias("model_version"),
        digest.alias("feature_hash"))


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}_manifest"


def append_audit(rows: DataFrame, path: str) -> None:
    """Write one batch's rows into its own batch_id partition (idempotent on replay), then its count and greatest
    id into the manifest beside the trail."""
    rows = rows.persist()  # the time of scoring is the same in both
    try:
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(path))
        (rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("row_id").alias("last_id")).coalesce(1)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
         .parquet(_manifest(path)))
    finally:
        rows.unpersist()


def audit_tail(spark: SparkSession, path: str, input_schema, n: int = 10) -> DataFrame:
    """The last ``n`` rows by id, newest first, JSON input parsed back (TakeOrdered).

    The manifest (one row for each batch) names the newest batches that
    together hold ``n`` rows; of the trail only their folders are read.
    """
    newest = spark.read.parquet(_manifest(path)).orderBy(F.desc("batch_id")).limit(n).collect()
    total, folders = 0, []
    for r in newest:
        total += r["n"]
        folders.append(f"{path.rstrip('/')}/batch_id={r['batch_id']}")
        if total >= n:
            break
    rows = spark.read.option("basePath", path).parquet(*folders).withColumn("batch_id", F.col("batch_id").cast("long"))
    return (rows.orderBy(F.desc("batch_id"), F.desc("row_id")).limit(n)
            .withColumn("input", F.from_json("input_data", input_schema)))
