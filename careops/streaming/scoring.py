"""Scoring streams for risk and claim requests (C6): request files in, scored rows, rejects and audit out.

``readStream`` with an explicit schema over a folder of JSON request files,
then ``foreachBatch``: check (C1), enrich claims (C3), score (C4 / C5), and
write three outputs under ``batch_id=<n>``.  Each output partition is
overwritten by its own batch id, so a batch replayed after a failure (the
checkpoint did not record it) rewrites the same rows instead of appending
duplicates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from careops.operators import models, scoring
from careops.operators.features import Aggregates
from careops.sources.audit import append_audit, audit_rows


@dataclass(frozen=True)
class Endpoint:
    """What a kind of request is checked, scored and recorded as."""
    name: str
    request: T.StructType
    fields: tuple[str, ...]
    spec: models.FeatureSpec


RISK = Endpoint("/predict/risk", scoring.RISK_REQUEST, tuple(scoring.RISK_FIELDS), models.SPEC_A)
CLAIM = Endpoint("/predict/claim", scoring.CLAIM_REQUEST, tuple(scoring.CLAIM_FIELDS), models.SPEC_B)


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def score_requests(requests: DataFrame, endpoint: Endpoint, model, version: str,
                   enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Valid requests with prediction, raw input and its hash."""
    raw = requests.withColumn("input_data", scoring.request_json(endpoint.fields)) \
        .withColumn("feature_hash", scoring.feature_hash(endpoint.fields))
    inputs = models.model_input(enrich(raw) if enrich else raw, endpoint.spec,
                                passthrough=["input_data", "feature_hash"])
    return models.predictions(model, inputs, endpoint.spec, version)


def score_batch(batch: DataFrame, batch_id: int, endpoint: Endpoint, model, out_dir: str, version: str,
                enrich: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """One micro-batch: check, score, then scored / rejects / audit writes."""
    checked = scoring.check_requests(batch, endpoint.fields).persist()
    valid = checked.where(F.size("reasons") == 0).drop("reasons")
    rejects = checked.where(F.size("reasons") > 0).withColumn("reasons", F.concat_ws(";", "reasons"))
    scored = score_requests(valid, endpoint, model, version, enrich).persist()
    _write(scored, f"{out_dir}/scored", batch_id)
    _write(rejects, f"{out_dir}/rejects", batch_id)
    append_audit(audit_rows(scored, endpoint.name, batch_id), f"{out_dir}/audit")
    scored.unpersist()
    checked.unpersist()


def start_scoring(spark: SparkSession, endpoint: Endpoint, requests_dir: str, out_dir: str, checkpoint: str, model,
                  version: str = "v1", enrich: Callable[[DataFrame], DataFrame] | None = None,
                  available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start a scoring stream (``availableNow`` drains what is there, then stops)."""
    reader = spark.readStream.schema(endpoint.request)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = (reader.json(requests_dir).writeStream
              .foreachBatch(lambda df, bid: score_batch(df, bid, endpoint, model, out_dir, version, enrich))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def score_claim_batch(batch: DataFrame, batch_id: int, model, rates: Aggregates, out_dir: str,
                      version: str) -> None:
    """:func:`score_batch` of claim requests with the scoring-time rates."""
    score_batch(batch, batch_id, CLAIM, model, out_dir, version, lambda df: scoring.enrich_claims(df, rates))


def start_claim_scoring(spark: SparkSession, requests_dir: str, out_dir: str, checkpoint: str, model,
                        rates: Aggregates, version: str = "v1", available_now: bool = True,
                        max_files_per_trigger: int | None = None) -> StreamingQuery:
    """:func:`start_scoring` of claim requests with the scoring-time rates."""
    return start_scoring(spark, CLAIM, requests_dir, out_dir, checkpoint, model, version,
                         scoring.claim_enricher(rates), available_now, max_files_per_trigger)


def start_risk_scoring(spark: SparkSession, requests_dir: str, out_dir: str, checkpoint: str, model,
                       version: str = "v1", available_now: bool = True,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    """:func:`start_scoring` of risk requests."""
    return start_scoring(spark, RISK, requests_dir, out_dir, checkpoint, model, version, None,
                         available_now, max_files_per_trigger)
