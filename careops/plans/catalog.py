"""Registry of named queries: Spark callables (spark, sf_dir) -> DataFrame, and DuckDB oracles.

Each query reads the driver tables under ``sf_dir`` through the fixture
mapping, so its work grows with those tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops import schema as S
from careops.functions.joins import null_safe_join
from careops.operators import (bi, boosting, drift, evaluation, features, governance, models, profiling,
                               quality, scoring)
from careops.plans.oracle_bi import B as _B_SQL
from careops.plans.oracle_drift import K as _K_SQL
from careops.plans.oracle_eval import V as _V_SQL
from careops.plans.oracle_eval import W as _W_SQL
from careops.plans.oracle_models import M as _M_SQL
from careops.plans.oracle_features import F as _F_SQL
from careops.plans.oracle_quality import Q as _Q_SQL
from careops.sources import keys
from careops.sources.fixtures import load_hospital
from careops.session import cut_lineage, scratch_path
from careops.sources import csv_ingest, layout
from careops.sources.master import load_joined
from careops.streaming.scoring import CLAIM, RISK, start_scoring

QueryFn = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return load_hospital(spark, sf_dir)


def _pvb(fn):
    def run(spark, sf_dir):
        t = _tables(spark, sf_dir)
        return fn(t["patients"], t["visits"], t["billing"])
    return run


def _v(fn):
    def run(spark, sf_dir):
        return fn(_tables(spark, sf_dir)["visits"])
    return run


def _b(fn):
    def run(spark, sf_dir):
        return fn(_tables(spark, sf_dir)["billing"])
    return run


def _vb(fn):
    def run(spark, sf_dir):
        t = _tables(spark, sf_dir)
        return fn(t["visits"], t["billing"])
    return run


def _pv(fn):
    def run(spark, sf_dir):
        t = _tables(spark, sf_dir)
        return fn(t["patients"], t["visits"])
    return run


def _decimals_as_double(df: DataFrame) -> DataFrame:
    """Registered outputs carry money as DOUBLE so both engines compare alike."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


def _master(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return load_joined(t["patients"], t["visits"], t["billing"])


def _key_contract(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return keys.key_contract_report(t["staging_patients"], t["staging_visits"], t["billing"])


def _cascade(spark, sf_dir):
    t = _tables(spark, sf_dir)
    dead = t["patients"].where(quality.missing_provider_condition(F.col("insurance_provider")))
    return keys.cascade_report(t["patients"], t["visits"], t["billing"], dead.select("patient_id"))


def _orphan_bills(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return quality.bills_without_visit(t["staging_visits"], t["billing"])


def _dup_patients(spark, sf_dir):
    return quality.duplicate_keys(_tables(spark, sf_dir)["staging_patients"], "patient_id")


def _on_master(fn):
    def run(spark, sf_dir):
        return fn(_master(spark, sf_dir))
    return run


def _split(spark, sf_dir):
    keys = _master(spark, sf_dir).select("visit_id", "bill_id", "visit_date")
    return features.time_split(keys).select("visit_id", "bill_id", "split")


def _train_aggs(spark, sf_dir):
    split = features.time_split(_master(spark, sf_dir).select(*RATE_INPUTS))
    return features.aggregates_long(features.fit_aggregates(split.where(F.col("split") == "train")))


def model_table(spark, sf_dir):
    return features.model_table(_master(spark, sf_dir))


def _frame_rates(spark, sf_dir):
    out = features.transform_features(_master(spark, sf_dir), None)
    return out.select("visit_id", "bill_id", "visit_frequency", "avg_length_of_stay_patient",
                      "provider_rejection_rate", "revenue_realization_rate_dept")


def _current_aggs(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return features.aggregates_long(features.current_aggregates(t["patients"], t["visits"], t["billing"]))


def _imputed(spark, sf_dir):
    out = profiling.impute(_master(spark, sf_dir))
    return out.select("visit_id", "bill_id", "department", "length_of_stay_hours",
                      "approved_amount", "payment_days")


def _drift(spark, sf_dir):
    return _drift_between_splits(model_table(spark, sf_dir))


def _drift_between_splits(mt):
    columns = dict.fromkeys([*S.DRIFT_NUMERIC, *S.DRIFT_CATEGORICAL, "split"])
    mt = cut_lineage(mt.select(*columns))
    return drift.drift_report(mt.where(F.col("split") == "train"), mt.where(F.col("split") == "test"))


EVAL_INPUTS = ["visit_id", "bill_id", "visit_date", "visit_type", "length_of_stay_hours", "risk_score", "claim_status",
               "billed_amount", "gender", "city", "insurance_provider"]
RATE_INPUTS = ["visit_id", "bill_id", "visit_date", "insurance_provider", "department", "claim_status", "billed_amount",
               "approved_amount"]


def _scored(spark, sf_dir):
    """Split master (the columns that evaluation looks at) with encoded targets and rule-baseline predictions."""
    split = features.time_split(_master(spark, sf_dir).select(*EVAL_INPUTS))
    return evaluation.rule_baseline(evaluation.with_targets(split))


def _ev(spark, sf_dir):
    return _scored(spark, sf_dir).where(F.col("split") == "test")


def _report(actual, pred, classes):
    return lambda spark, sf_dir: evaluation.classification_report(_ev(spark, sf_dir), actual, pred, classes)


def _matrix(actual, pred, classes, normalize):
    return lambda spark, sf_dir: evaluation.confusion_matrix(_ev(spark, sf_dir), actual, pred, classes,
                                                             normalize)


def _on_model(predict, spec, fn):
    """An evaluation table of a model's predictions on the test rows."""
    def run(spark, sf_dir):
        p = predict(spark, sf_dir).where(F.col("split") == "test")
        return fn(p, "actual_label", "pred_label", spec.classes)
    return run


def _weekly(spark, sf_dir):
    return governance.weekly_metrics(_ev(spark, sf_dir), "visit_date", "claim_label", "claim_pred")


def _triggers(spark, sf_dir):
    """W2 with the metrics and the drift report read off one model table."""
    mt = cut_lineage(model_table(spark, sf_dir).select(
        *dict.fromkeys([*EVAL_INPUTS, *S.DRIFT_NUMERIC, *S.DRIFT_CATEGORICAL, "split"])))
    scored = evaluation.rule_baseline(evaluation.with_targets(mt))
    ev = scored.where(F.col("split") == "test")
    trained_on = scored.where(F.col("split") == "train").agg(F.max("visit_date")).scalar()
    metrics = governance.weekly_metrics(ev, "visit_date", "claim_label", "claim_pred")
    return governance.retrain_triggers(metrics, trained_on, _drift_between_splits(mt).agg(F.max("PSI")).scalar())


def _pull(spark, sf_dir):
    return governance.training_pull(_master(spark, sf_dir)).select(
        "visit_id", "bill_id", "visit_date", "claim_status")


def _gate(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    active = ev.withColumn("majority_pred", F.lit(0))
    return governance.promotion_gate(active.select("visit_id", "bill_id", "claim_label",
                                                   F.col("majority_pred").alias("claim_pred")),
                                     ev, ["visit_id", "bill_id"], "claim_label", "claim_pred")


def _target_distribution(spark, sf_dir):
    t = evaluation.with_targets(model_table(spark, sf_dir))
    n = t.agg(F.count(F.lit(1))).scalar()

    def dist(col):
        return t.groupBy(F.col(col).alias("value")).agg(
            F.bround(F.count(F.lit(1)) / n, 3).alias("share")).select(
            F.lit(col).alias("target"), "value", "share")
    return dist("risk_score").unionByName(dist("claim_status"))


def _class_weights(spark, sf_dir):
    t = evaluation.with_targets(model_table(spark, sf_dir)).where(F.col("split") == "train")
    w = models.class_weights(t.select(F.col("claim_label").cast("double").alias("claim_label")), "claim_label")
    return w.select("claim_label", F.round("class_weight", 6).alias("class_weight"))


def _fold_counts(spark, sf_dir):
    """Rows per class and stratified fold of the training rows."""
    train, _ = _split_inputs(spark, sf_dir, models.SPEC_A)
    folded = models.with_folds(train, label=models.SPEC_A.label)
    return folded.groupBy(F.col(models.SPEC_A.label).cast("int").alias("label"), "fold").agg(
        F.count(F.lit(1)).alias("row_count"))


def _split_inputs(spark, sf_dir, spec):
    """Training rows, and all rows (train and test) to score."""
    data = cut_lineage(models.model_input(evaluation.with_targets(model_table(spark, sf_dir)), spec))
    return data.where(F.col("split") == "train"), data


def _prepared_inputs(spark, sf_dir, spec):
    """Fitted preprocessing, prepared training rows, and all prepared rows to score."""
    prep, rows = models.prepare(_split_inputs(spark, sf_dir, spec)[1], spec)
    return prep, rows.where(F.col("split") == "train"), rows


def _encoded(spec):
    """M3 + M4 fitted on the training rows, applied to all rows."""
    def run(spark, sf_dir):
        from pyspark.ml import Pipeline
        train, rows = _split_inputs(spark, sf_dir, spec)
        out = models.encoded_rows(Pipeline(stages=models.preprocessing(spec)).fit(train), rows, spec,
                                  ["visit_id", "bill_id"])
        return out.select(*[F.round(c, 6).alias(c) if c.startswith("num_") else c for c in out.columns])
    return run


def _scored_rows(predict, spec):
    """V1: the rows that a model scores, with their labels and what must hold of each prediction."""
    def run(spark, sf_dir):
        p = predict(spark, sf_dir)
        shares = F.array(*[F.col(f"p_{c}") for c in spec.classes])
        return p.select("visit_id", "bill_id", "split", "actual_label", "n_filled",
                        F.round(F.aggregate(shares, F.lit(0.0), lambda a, b: a + b), 4).alias("p_sum"),
                        (F.element_at(shares, F.col("pred_label") + 1) == F.array_max(shares)).alias("is_largest"))
    return run


def _flat_predictions(pred: DataFrame, spec) -> DataFrame:
    return pred.select("visit_id", "bill_id", "split", "n_filled", F.col(spec.label).cast("int").alias("actual_label"),
                       "pred_label", "predicted_class", "model_version",
                       *[F.round(F.col("probabilities")[c], 6).alias(f"p_{c}") for c in spec.classes])


def _risk_logistic(spark, sf_dir):
    model, rows = _risk_logistic_model(spark, sf_dir)
    return _flat_predictions(models.predictions(model.stages[-1], rows, models.SPEC_A, "risk-lr"), models.SPEC_A)


def _risk_logistic_model(spark, sf_dir):
    """The fitted risk model and the prepared rows to score."""
    prep, train, rows = _prepared_inputs(spark, sf_dir, models.SPEC_A)
    return models.fit_prepared(models.logistic(models.SPEC_A, train.count()), prep, train), rows


def _risk_forest_model(spark, sf_dir):
    """The fitted forest and the prepared rows to score."""
    prep, train, rows = _prepared_inputs(spark, sf_dir, models.SPEC_A)
    pipe, rf = models.forest(models.SPEC_A)
    rf.setNumTrees(50).setMaxDepth(10)
    return models.fit_prepared(pipe, prep, train), rows


def _risk_forest(spark, sf_dir):
    model, rows = _risk_forest_model(spark, sf_dir)
    return _flat_predictions(models.predictions(model.stages[-1], rows, models.SPEC_A, "risk-rf"), models.SPEC_A)


def _forest_importances(spark, sf_dir):
    return models.feature_importances(_risk_forest_model(spark, sf_dir)[0], models.SPEC_A, spark)


def _claim_logistic_model(spark, sf_dir):
    """The fitted claim model and the prepared rows to score."""
    prep, train, rows = _prepared_inputs(spark, sf_dir, models.SPEC_B)
    train = models.balanced_weights(train, models.SPEC_B.label)
    return models.fit_prepared(models.logistic(models.SPEC_B, train.count(), weighted=True), prep, train), rows


def _claim_logistic(spark, sf_dir):
    model, rows = _claim_logistic_model(spark, sf_dir)
    return _flat_predictions(models.predictions(model.stages[-1], rows, models.SPEC_B, "claim-lr"), models.SPEC_B)


def _claim_logistic_rows(spark, sf_dir):
    """The claim model's predictions on the test rows, with the columns that evaluation looks at."""
    model, rows = _claim_logistic_model(spark, sf_dir)
    return models.predictions(model.stages[-1], rows.where("split = 'test'"), models.SPEC_B, "claim-lr").withColumn(
        "claim_label", F.col("claim_label").cast("int"))


def _model_evaluation(spark, sf_dir):
    """V2, V4, V5 and V7 of one fitted claim model, as (report, segment, item, metric, value)."""
    pred = cut_lineage(_claim_logistic_rows(spark, sf_dir))
    classes = models.SPEC_B.classes

    def long(df, report, segment, item, metrics):
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return df.select(F.lit(report).alias("report"), segment.cast("string").alias("segment"),
                         item.cast("string").alias("item"), F.inline(pairs))
    none = F.lit(None)
    return (long(evaluation.classification_report(pred, "claim_label", "pred_label", classes), "classes", none, F.col("label"),
                 ["precision", "recall", "f1_score", "support"])
            .unionByName(long(evaluation.confusion_matrix(pred, "claim_label", "pred_label", classes, True), "confusion", none,
                              F.col("actual"), [f"pred_{c}" for c in classes]))
            .unionByName(long(evaluation.revenue_protection(pred, "claim_label", "pred_label"), "revenue", none, none,
                              ["total_rejected_billed", "flagged_rejected_billed", "flagged_pct"]))
            .unionByName(long(evaluation.fairness(pred, "claim_label", "pred_label", ["gender", "city", "insurance_provider"]),
                              "fairness", F.col("segment"), F.col("segment_value"),
                              ["volume", "accuracy", "weighted_f1", "positive_recall"])))


def _linear_importances(spark, sf_dir):
    return models.feature_importances(_risk_logistic_model(spark, sf_dir)[0], models.SPEC_A, spark)


def _persisted(spark, sf_dir):
    """A fitted pipeline saved and loaded; whether it scores every row as the one that was saved does."""
    from pyspark.ml import PipelineModel
    model, rows = _risk_logistic_model(spark, sf_dir)
    rows = rows.drop("features")  # the whole pipeline prepares them again
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    keys = ["visit_id", "bill_id"]
    first, again = (models.predictions(m, rows, models.SPEC_A).select(*keys, "predicted_class", "probabilities")
                    for m in (model, PipelineModel.load(path)))
    again = again.withColumnsRenamed({"predicted_class": "loaded_class", "probabilities": "loaded_probabilities"})
    alike = ((F.col("predicted_class") == F.col("loaded_class"))
             & (F.map_values("probabilities") == F.map_values("loaded_probabilities")))
    return null_safe_join(first, again, keys).select(*keys, alike.alias("scores_alike"))


def _claim_joint(spark, sf_dir):
    train, rows = _split_inputs(spark, sf_dir, models.SPEC_B)
    model = models.fit_joint_boosting(train, models.SPEC_B, max_iter=50, max_depth=5, step_size=0.1)
    return _flat_predictions(models.predictions(model, rows, models.SPEC_B, "claim-joint"), models.SPEC_B)


def _search_table(spark, sf_dir):
    """The joint booster's search over its whole grid, one row per point and fold, with what must hold of each row and of the choice."""
    train, _ = _split_inputs(spark, sf_dir, models.SPEC_B)
    table, _ = models.search_joint_boosting(train, models.SPEC_B, models.GBT_GRID, refit=False)
    best = boosting.best_point(table)
    rows = spark.createDataFrame(table)
    point = ["maxIter", "maxDepth", "stepSize"]
    means = rows.groupBy(*point).agg(F.avg("accuracy").alias("mean"))
    top = means.agg(F.max("mean")).scalar()
    chosen = F.lit(True)
    for name in point:
        chosen = chosen & (F.col(name) == best[name])
    fits = F.coalesce(means.where(chosen).select("mean").scalar() >= top - 1e-12, F.lit(False))
    return rows.select(F.col("maxIter").cast("int").alias("max_iter"), F.col("maxDepth").cast("int").alias("max_depth"),
                       F.col("stepSize").alias("step_size"), F.col("fold").cast("int").alias("fold"),
                       F.col("rows").cast("long").alias("row_count"),
                       (F.col("accuracy") == F.col("right") / F.col("rows")).alias("is_share"), fits.alias("choice_is_best"))


def _claim_gbt(spark, sf_dir):
    train, rows = _split_inputs(spark, sf_dir, models.SPEC_B)
    model = models.fit_ovr_gbt(train, models.SPEC_B, max_iter=50, max_depth=5, step_size=0.1)
    return _flat_predictions(models.predictions(model, rows, models.SPEC_B, "claim-gbt"), models.SPEC_B)


def _requests(spark, sf_dir):
    return scoring.requests_from(model_table(spark, sf_dir))


def _request_check(spark, sf_dir):
    checked = scoring.check_requests(_requests(spark, sf_dir))
    return checked.select("visit_id", "bill_id", F.concat_ws(";", "reasons").alias("reasons"),
                          (F.size("reasons") == 0).alias("valid"))


def _feature_hash(spark, sf_dir):
    return _requests(spark, sf_dir).select("visit_id", "bill_id",
                                           scoring.feature_hash().alias("feature_hash"))


def _enrichment(spark, sf_dir):
    t = _tables(spark, sf_dir)
    rates = features.current_aggregates(t["patients"], t["visits"], t["billing"])
    out = scoring.enrich_claims(_requests(spark, sf_dir), rates)
    return out.select("visit_id", "bill_id", "provider_rejection_rate", "revenue_realization_rate_dept")


def _csv_roundtrip(table):
    """A table written as CSV to a scratch folder and read back through the typed ingest."""
    def run(spark, sf_dir):
        path = scratch_path(spark, f"csv-{table}")
        csv_ingest.write_csv(_tables(spark, sf_dir)[table], path)
        return csv_ingest.read_typed_csv(spark, path, S.TABLES[table])
    return run


def _reloaded(table):
    """S3 + S5: all tables rewritten parent first with the filter-friendly layout; the rows of one read back."""
    def run(spark, sf_dir):
        t = _tables(spark, sf_dir)
        base = scratch_path(spark, "tables")
        layout.reload_tables(t, base)
        return layout.read_snapshot(spark, base)[table].select(*t[table].columns)
    return run


def _cascaded(table):
    """The tables reloaded, then without the patients of no known provider, published as the next snapshot."""
    def run(spark, sf_dir):
        t = _tables(spark, sf_dir)
        base = scratch_path(spark, "tables")
        dead = t["patients"].where(quality.missing_provider_condition(F.col("insurance_provider")))
        left = keys.cascade_delete(t["patients"], t["visits"], t["billing"], dead.select("patient_id"))
        layout.reload_tables(dict(zip(layout.TABLES, left)), base)
        return layout.read_snapshot(spark, base)[table].select(*t[table].columns)
    return run


def _drift_sink(spark, sf_dir):
    """The drift report written as one CSV file and read back."""
    path = scratch_path(spark, "drift")
    report = _drift(spark, sf_dir)
    layout.write_drift_report(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


def _exported(spark, sf_dir):
    """Model table exported partitioned by split, read back."""
    path = scratch_path(spark, "model-table")
    mt = model_table(spark, sf_dir)
    layout.export_model_table(mt, path)
    return spark.read.parquet(path).select(*mt.columns)


def _export_counts(spark, sf_dir):
    """Model table exported partitioned by split, read back, rows per split."""
    return _exported(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("row_count"))


def _reload_counts(spark, sf_dir):
    """S3 + S5: tables rewritten parent first with the filter-friendly layout, rows read back."""
    t = _tables(spark, sf_dir)
    paths = layout.reload_tables(t, scratch_path(spark, "tables"))
    out = None
    for name in ("patients", "visits", "billing"):
        part = spark.read.parquet(paths[name]).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def _audit_tail(spark, sf_dir):
    """S8 + S9: rule-scored claim requests appended to the audit trail, then its last 10 rows."""
    from careops.sources import audit
    scored = evaluation.rule_baseline(model_table(spark, sf_dir)).withColumn(
        "predicted_class", F.element_at(F.array(*[F.lit(c) for c in S.CLAIM_CLASSES]), F.col("claim_pred") + 1)
    ).withColumn("model_version", F.lit("rule-baseline"))
    req = scoring.requests_from(scored, scoring.CLAIM_FIELDS, ["predicted_class", "model_version", "visit_id", "bill_id"])
    path = scratch_path(spark, "audit")
    audit.append_audit(audit.audit_rows(req, "/predict/claim", 0, scoring.CLAIM_FIELDS, keys=["visit_id", "bill_id"]), path)
    tail = audit.audit_tail(spark, path, scoring.CLAIM_REQUEST)
    return tail.select("batch_id", "endpoint", "prediction", "model_version", "feature_hash",
                       F.col("input.age").alias("age"), F.col("input.billed_amount").alias("billed_amount"))


def _lose_last_commit(spark, checkpoint):
    """Delete the newest entry of a stream's commit log, as if the driver had died before writing it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, max((n for n in names if n.isdigit()), key=int)), False)


REQUEST_ROWS = 1_000_000  # rows that the task of a request file goes through, where the table has more tasks than files


def _scoring_stream(endpoint, rule):
    """Requests as JSON files through the scoring stream in two runs; the last commit of the first one is lost.

    Returns the rows of all three outputs: what was scored, rejected and recorded.
    """
    def run(spark, sf_dir):
        base = scratch_path(spark, "stream")
        requests = cut_lineage(scoring.requests_from(model_table(spark, sf_dir), endpoint.fields))
        enrich = None
        if "provider_rejection_rate" in endpoint.spec.numeric:
            t = _tables(spark, sf_dir)
            rates = features.current_aggregates(t["patients"], t["visits"], t["billing"])
            rates = features.Aggregates(*(cut_lineage(x) for x in (rates.provider_rejection, rates.dept_realization, rates.globals)))
            enrich = scoring.claim_enricher(rates)
        model = evaluation.RuleModel(rule, len(endpoint.spec.classes))
        half = F.pmod(F.xxhash64("visit_id", "bill_id"), F.lit(2))
        # files of bounded size: a batch takes three, and more batches than needed cost time
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-requests.count() // REQUEST_ROWS))
        requests = requests.coalesce(files)
        for part in (0, 1):
            requests.where(half == part).select(*endpoint.fields).write.mode("append").json(f"{base}/requests")
            start_scoring(spark, endpoint, f"{base}/requests", f"{base}/out", f"{base}/checkpoint", model, "rule", enrich,
                          max_files_per_trigger=3).awaitTermination()
            if part == 0:
                _lose_last_commit(spark, f"{base}/checkpoint")
        scored, rejects, recorded = (spark.read.parquet(f"{base}/out/{x}") for x in ("scored", "rejects", "audit"))
        rejected = rejects.withColumn("feature_hash", scoring.feature_hash(endpoint.fields))
        return (scored.select(F.lit("scored").alias("output"), "feature_hash", F.col("predicted_class").alias("result"))
                .unionByName(rejected.select(F.lit("rejects").alias("output"), "feature_hash", F.col("reasons").alias("result")))
                .unionByName(recorded.select(F.lit("audit").alias("output"), "feature_hash", F.col("prediction").alias("result"))))
    return run


LATE_BOUND = "60 days"


def _late_outcomes(spark, sf_dir):
    """W1 over two streams: rule predictions at the visit, outcomes when the bill comes; weekly metrics of those that
    come within LATE_BOUND, and how many came later."""
    from careops.streaming import audit as stream
    base = scratch_path(spark, "outcomes")
    split = features.time_split(_master(spark, sf_dir).select(*EVAL_INPUTS, "billing_date"))
    ev = cut_lineage(evaluation.rule_baseline(evaluation.with_targets(split)).where("split = 'test'"))
    key = F.concat_ws(":", "visit_id", "bill_id").alias("key")
    made = ev.select(key, stream.utc_midnight(F.col("visit_date")).alias("ts"), F.col("claim_pred").alias("predicted"))
    known = ev.select(key, stream.utc_midnight(F.col("billing_date")).alias("outcome_ts"), F.col("claim_label").alias("actual"))
    made.write.parquet(f"{base}/made")
    known.write.parquet(f"{base}/known")
    # later rows without a partner move both watermarks past all windows of the others
    far = ev.agg((stream.utc_midnight(F.greatest(F.max("visit_date"), F.max("billing_date"))) + F.expr("INTERVAL 400 DAYS")).alias("t"))
    far.select(F.lit("none").alias("key"), F.col("t").alias("ts"), F.lit(0).alias("predicted")).write.mode("append").parquet(f"{base}/made")
    far.select(F.lit("nil").alias("key"), F.col("t").alias("outcome_ts"), F.lit(0).alias("actual")).write.mode("append").parquet(f"{base}/known")
    for _ in range(2):  # the second run emits what the first one's last watermark closed
        stream.weekly_outcomes_stream(spark, f"{base}/made", f"{base}/known", f"{base}/weekly", f"{base}/checkpoint",
                                      LATE_BOUND).awaitTermination()
    late = stream.late_outcomes(made, known, LATE_BOUND)
    return (spark.read.parquet(f"{base}/weekly").join(late, "week_start", "left")
            .withColumn("late", F.coalesce("late", F.lit(0)).cast("long")))


QUERIES: dict[str, QueryFn] = {
    "b01_visits_by_department": _v(bi.visits_by_department),
    "b02_longest_stay_departments": _v(bi.longest_stay_departments),
    "b03_high_risk_share": _v(bi.high_risk_share_by_department),
    "b04_visits_per_patient_by_city": _pv(bi.visits_per_patient_by_city),
    "b05_top_high_risk_doctors": _v(bi.top_high_risk_doctors),
    "b06_billed_by_provider": _pvb(bi.billed_by_provider),
    "b07_top_rejection_rate": _pvb(bi.rejection_rate_by_provider),
    "b08_payment_delay_by_provider": _pvb(bi.payment_delay_by_provider),
    "b09_realization_by_department": _vb(bi.realization_by_department),
    "b10_unapproved_high_bills": _vb(bi.unapproved_high_bills),
    "b11_table_row_counts": _pvb(bi.table_row_counts),
    "b12_overall_avg_stay": _v(bi.overall_avg_stay),
    "b13_stay_by_department": _v(bi.stay_by_department),
    "b14_visits_by_risk": _v(bi.visits_by_risk),
    "b15_claims_by_status": _b(bi.claims_by_status),
    "b16_rejections_by_provider": _pvb(bi.rejections_by_provider),
    "b17_payments_by_provider": _pvb(bi.payments_by_provider),
    "b18_provider_summary": _pvb(bi.provider_summary),
    "q01_visits_without_bill": _vb(quality.visits_without_bill),
    "q02_bills_without_visit": _orphan_bills,
    "q03_duplicate_patients": _dup_patients,
    "q04_invalid_length_of_stay": _v(quality.invalid_length_of_stay),
    "q05_invalid_payment_days": _b(quality.invalid_payment_days),
    "q06_visits_missing_insurance": _pv(quality.visits_missing_insurance),
    "q07_q09_validation_report": _pvb(quality.validation_report),
    "q10_invalid_rows": _pvb(quality.invalid_rows),
    "s02_key_contract": _key_contract,
    "s04_cascade_delete": _cascade,
    "s06_master_frame": _master,
    "e01_missing_summary": _on_master(profiling.missing_summary),
    "e02_category_counts": _on_master(profiling.category_counts),
    "e03_iqr_outliers": _on_master(profiling.iqr_outliers),
    "e04_box_summary": _on_master(profiling.box_summary),
    "e05_imputed_values": _imputed,
    "f01_time_split": _split,
    "f02_f05_train_aggregates": _train_aggs,
    "f06_f12_model_table": model_table,
    "f08_causal_visit_frequency": lambda spark, sf_dir: features.causal_visit_frequency(
        _master(spark, sf_dir)).select("visit_id", "bill_id", "visit_frequency_causal"),
    "f11_frame_rates": _frame_rates,
    "f13_current_aggregates": _current_aggs,
    "k05_drift_report": _drift,
    "v02_report_risk_rule": _report("risk_label", "risk_pred", S.RISK_CLASSES),
    "v02_report_claim_rule": _report("claim_label", "claim_pred", S.CLAIM_CLASSES),
    "v03_confusion_claim_rule": _matrix("claim_label", "claim_pred", S.CLAIM_CLASSES, False),
    "v04_normalized_confusion_risk_rule": _matrix("risk_label", "risk_pred", S.RISK_CLASSES, True),
    "v05_revenue_protection_rule": lambda spark, sf_dir: evaluation.revenue_protection(_ev(spark, sf_dir)),
    "v07_fairness_claim_rule": lambda spark, sf_dir: evaluation.fairness(
        _ev(spark, sf_dir), "claim_label", "claim_pred", ["gender", "city", "insurance_provider"]),
    "w01_weekly_audit_metrics": _weekly,
    "w02_retrain_triggers": _triggers,
    "w03_training_pull": _pull,
    "w04_promotion_gate": _gate,
    "m02_target_distribution": _target_distribution,
    "m05_class_weights": _class_weights,
    "m06_risk_logistic_predictions": _risk_logistic,
    "m07_risk_forest_predictions": _risk_forest,
    "m08_claim_logistic_predictions": _claim_logistic,
    "m09_claim_gbt_predictions": _claim_gbt,
    "v06_feature_importances_risk_forest": _forest_importances,
    "c01_claim_request_check": _request_check,
    "c02_feature_hash": _feature_hash,
    "c03_claim_enrichment": _enrichment,
    "m03_m04_encoded_rows_risk": _encoded(models.SPEC_A),
    "m03_m04_encoded_rows_claim": _encoded(models.SPEC_B),
    "v01_scored_rows_risk_logistic": _scored_rows(_risk_logistic, models.SPEC_A),
    "v01_scored_rows_claim_logistic": _scored_rows(_claim_logistic, models.SPEC_B),
    "v02_report_risk_logistic": _on_model(_risk_logistic, models.SPEC_A, evaluation.classification_report),
    "v02_report_claim_logistic": _on_model(_claim_logistic, models.SPEC_B, evaluation.classification_report),
    "v03_confusion_claim_logistic": _on_model(_claim_logistic, models.SPEC_B, evaluation.confusion_matrix),
    "m10_fold_counts": _fold_counts,
    "s01_csv_roundtrip_patients": _csv_roundtrip("patients"),
    "s01_csv_roundtrip_visits": _csv_roundtrip("visits"),
    "s01_csv_roundtrip_billing": _csv_roundtrip("billing"),
    "s03_reloaded_patients": _reloaded("patients"),
    "s03_reloaded_visits": _reloaded("visits"),
    "s03_reloaded_billing": _reloaded("billing"),
    "s04_cascaded_patients": _cascaded("patients"),
    "s04_cascaded_visits": _cascaded("visits"),
    "s04_cascaded_billing": _cascaded("billing"),
    "s07_exported_model_table": _exported,
    "s10_drift_sink": _drift_sink,
    "s03_s05_reload_counts": _reload_counts,
    "s07_model_table_export": _export_counts,
    "s08_s09_audit_tail": _audit_tail,
    "v02_v07_claim_logistic_evaluation": _model_evaluation,
    "v06_feature_importances_risk_logistic": _linear_importances,
    "m11_persisted_risk_logistic": _persisted,
    "m09_claim_joint_predictions": _claim_joint,
    "m10_search_claim_joint": _search_table,
    "c06_risk_scoring_stream": _scoring_stream(RISK, "risk_pred"),
    "c06_claim_scoring_stream": _scoring_stream(CLAIM, "claim_pred"),
    "w01_late_outcomes_stream": _late_outcomes,
}
QUERIES = {name: (lambda fn: (lambda spark, sf_dir: _decimals_as_double(fn(spark, sf_dir))))(fn)
           for name, fn in QUERIES.items()}

ORACLES: dict[str, str] = {}
ORACLES.update(_B_SQL)
ORACLES.update(_Q_SQL)
ORACLES.update(_F_SQL)
ORACLES.update(_K_SQL)
ORACLES.update(_V_SQL)
ORACLES.update(_W_SQL)
ORACLES.update(_M_SQL)
