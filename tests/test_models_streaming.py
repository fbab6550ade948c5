"""ML structure, leakage rules, persistence; stream = batch and replay without duplicates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from careops.operators import evaluation, features, models, scoring
from careops.sources.audit import audit_tail
from careops.sources.master import load_joined
from careops.streaming.audit import weekly_metrics_stream
from careops.streaming.scoring import (RISK, score_claim_batch, score_requests, start_claim_scoring,
                                       start_risk_scoring)


@pytest.fixture(scope="module")
def table(spark, hospital):
    m = load_joined(hospital["patients"], hospital["visits"], hospital["billing"])
    mt = features.model_table(m)
    return evaluation.with_targets(mt).cache()


def test_forbidden_columns_are_rejected():
    bad = models.FeatureSpec("risk_label", ("a",), ("age", "billed_amount"), (), tuple(models.SPEC_A.forbidden))
    with pytest.raises(ValueError):
        models.check_features(bad)
    models.check_features(models.SPEC_A)
    models.check_features(models.SPEC_B)


def test_logistic_beats_majority_and_persists(spark, table, tmp_dir):
    # planted signal: the label follows length of stay, a model A feature
    los = F.col("length_of_stay_hours")
    planted = table.withColumn("risk_label", F.when(los >= 30, 2).when(los >= 15, 1).otherwise(0))
    data = models.model_input(planted, models.SPEC_A).where(F.col("length_of_stay_hours").isNotNull())
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    fitted = models.logistic(models.SPEC_A, train.count()).fit(train)
    path = f"{tmp_dir}/risk"
    fitted.write().overwrite().save(path)
    from pyspark.ml import PipelineModel
    loaded = PipelineModel.load(path)
    pred = models.predictions(loaded, test, models.SPEC_A)
    acc = pred.agg(F.avg((F.col("pred_label") == F.col("risk_label")).cast("double"))).first()[0]
    majority = test.groupBy("risk_label").count().agg(F.max("count")).first()[0] / test.count()
    assert acc > majority + 0.1
    probs = pred.select(F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert all(abs(r.s - 1) < 1e-6 for r in probs.collect())


def test_ovr_gbt_probabilities_and_reload(spark, table, tmp_dir):
    data = models.model_input(table, models.SPEC_B)
    train = data.where("split = 'train'")
    m = models.fit_ovr_gbt(train, models.SPEC_B, max_iter=5, max_depth=3)
    m.save(f"{tmp_dir}/gbt")
    again = models.OneVsRestGBTModel.load(f"{tmp_dir}/gbt")
    a = models.predictions(m, train, models.SPEC_B).orderBy("visit_id", "bill_id").collect()
    b = models.predictions(again, train, models.SPEC_B).orderBy("visit_id", "bill_id").collect()
    assert [r.predicted_class for r in a] == [r.predicted_class for r in b]
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 for r in a)
    imp = models.feature_importances(m, models.SPEC_B, spark).collect()
    assert len(imp) == 10 and imp[0].importance >= imp[-1].importance


def test_cross_validation_small_grid(spark, table):
    data = models.model_input(table, models.SPEC_A).where("split = 'train'")
    pipe, rf = models.forest(models.SPEC_A)
    best = models.cross_validate(pipe, rf, {"numTrees": [5], "maxDepth": [3, 5]}, data, "risk_label")
    assert best.stages[-1].getOrDefault("maxDepth") in (3, 5)


def _requests(table):
    return scoring.requests_from(table.where("split = 'test'"))


def test_stream_equals_batch_and_replay_has_no_duplicates(spark, table, hospital, tmp_dir):
    data = models.model_input(table, models.SPEC_B)
    model = models.fit_ovr_gbt(data.where("split = 'train'"), models.SPEC_B, max_iter=3, max_depth=3)
    rates = features.current_aggregates(hospital["patients"], hospital["visits"], hospital["billing"])
    req = _requests(table).drop("visit_id", "bill_id")
    src = f"{tmp_dir}/requests"
    req.repartition(3).write.json(src)
    out, ckpt = f"{tmp_dir}/out", f"{tmp_dir}/ckpt"
    q = start_claim_scoring(spark, src, out, ckpt, model, rates, "v-test")
    q.awaitTermination()
    streamed = spark.read.parquet(f"{out}/scored")
    rejects = spark.read.parquet(f"{out}/rejects")
    assert streamed.count() + rejects.count() == req.count()
    batch = scoring.check_requests(req).where(F.size("reasons") == 0).drop("reasons")
    batch = models.predictions(model, models.model_input(scoring.enrich_claims(batch, rates), models.SPEC_B),
                               models.SPEC_B, "v-test")
    key = ["age", "city", "billed_amount", "days_since_registration", "visit_month", "predicted_class"]
    assert sorted(map(tuple, streamed.select(key).collect()), key=str) == \
        sorted(map(tuple, batch.select(key).collect()), key=str)
    # replay batch 0 by hand (as after a lost commit): partitions are rewritten, not appended
    before = spark.read.parquet(f"{out}/audit").count()
    score_claim_batch(spark.read.json(src, schema=scoring.CLAIM_REQUEST), 0, model, rates, out, "v-test")
    assert spark.read.parquet(f"{out}/audit").count() == before
    tail = audit_tail(spark, f"{out}/audit", scoring.CLAIM_REQUEST).collect()
    assert len(tail) == 10 and all(len(r.feature_hash) == 64 for r in tail)


def test_risk_stream_equals_batch(spark, table, tmp_dir):
    data = models.model_input(table, models.SPEC_A)
    model = models.logistic(models.SPEC_A, 1000).fit(data.where("split = 'train'"))
    req = scoring.requests_from(table, scoring.RISK_FIELDS).drop("visit_id", "bill_id")
    req = req.unionByName(req.limit(3).withColumn("age", F.lit(200).cast("long")))
    src, out = f"{tmp_dir}/requests", f"{tmp_dir}/out"
    req.repartition(3).write.json(src)
    start_risk_scoring(spark, src, out, f"{tmp_dir}/ckpt", model, "v-test", max_files_per_trigger=1).awaitTermination()
    streamed, rejects = spark.read.parquet(f"{out}/scored"), spark.read.parquet(f"{out}/rejects")
    assert streamed.count() + rejects.count() == req.count() and rejects.where("reasons like '%range:age%'").count() >= 3
    valid = scoring.check_requests(req, scoring.RISK_FIELDS).where(F.size("reasons") == 0).drop("reasons")
    batch = score_requests(valid, RISK, model, "v-test")
    key = ["feature_hash", "predicted_class", "model_version"]
    assert sorted(map(tuple, streamed.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))
    assert spark.read.parquet(f"{out}/audit").where("endpoint = '/predict/risk'").count() == streamed.count()


def test_weekly_metrics_stream_matches_batch(spark, tmp_dir):
    from careops.operators.governance import weekly_metrics
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 3), i % 3, (i * 7) % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "ts timestamp, actual int, predicted int")
    batch = {r.week_start: r for r in weekly_metrics(df, "ts", "actual", "predicted").collect()}
    src = f"{tmp_dir}/labelled"
    df.write.parquet(src)
    # a later row moves the watermark past every window of the others
    last = dt.datetime(2024, 3, 1)
    spark.createDataFrame([(last, 0, 0)], df.schema).write.mode("append").parquet(src)
    for _ in range(2):  # the second run emits what the first one's last watermark closed
        weekly_metrics_stream(spark, src, f"{tmp_dir}/weekly", f"{tmp_dir}/wckpt", watermark="0 seconds").awaitTermination()
    streamed = {r.week_start: r for r in spark.read.parquet(f"{tmp_dir}/weekly").collect()}
    assert set(streamed) == set(batch) and len(batch) == 5
    for k, r in streamed.items():
        assert (r.volume, r.accuracy, r.rejected_recall) == (batch[k].volume, batch[k].accuracy,
                                                            batch[k].rejected_recall)


def test_evaluation_of_model_output_matches_brute_force(spark, table):
    data = models.model_input(table, models.SPEC_B)
    train = models.balanced_weights(data.where("split = 'train'"), "claim_label")
    model = models.logistic(models.SPEC_B, 1000, weighted=True).fit(train)
    pred = models.predictions(model, data.where("split = 'test'"), models.SPEC_B)
    rows = [(int(r.claim_label), r.pred_label) for r in pred.collect()]
    report = {r.label: r for r in evaluation.classification_report(
        pred.withColumn("claim_label", F.col("claim_label").cast("int")), "claim_label", "pred_label",
        models.SPEC_B.classes).collect()}
    for i, name in enumerate(models.SPEC_B.classes):
        hits = sum(a == b == i for a, b in rows)
        guessed, actual = sum(b == i for _, b in rows), sum(a == i for a, _ in rows)
        assert abs(report[name].precision - (hits / guessed if guessed else 0)) < 1e-4
        assert abs(report[name].recall - hits / actual) < 1e-4 and report[name].support == actual
    assert abs(report["accuracy"].f1_score - sum(a == b for a, b in rows) / len(rows)) < 1e-4


def test_gbt_grid_search_tiny_grid(spark, table):
    data = models.model_input(table, models.SPEC_B).where("split = 'train'")
    m = models.search_ovr_gbt(data, models.SPEC_B, {"maxIter": [2], "maxDepth": [2], "stepSize": [0.1]})
    assert m.params == {"maxIter": 2, "maxDepth": 2, "stepSize": 0.1}
    assert len(m.models) == 3


def test_weekly_windows_do_not_follow_the_session_zone(spark, tmp_dir):
    """Prediction and outcome streams under a session zone far from UTC: the same weeks as the batch result under UTC."""
    from careops.operators.governance import weekly_metrics
    from careops.streaming.audit import late_outcomes, utc_midnight, weekly_outcomes_stream
    rows = [(f"k{i}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 2), dt.date(2024, 1, 1) + dt.timedelta(days=i // 2 + i % 70),
             i % 3, (i * 7) % 3) for i in range(140)]
    rows.append(("far", dt.date(2026, 1, 1), None, 0, 0))
    frame = spark.createDataFrame(rows, "key string, day date, known date, actual int, predicted int")
    want = {r.week_start: r for r in weekly_metrics(frame.where("known <= date_add(day, 30)"), "day", "actual", "predicted").collect()}
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    try:
        made = frame.select("key", utc_midnight(F.col("day")).alias("ts"), "predicted")
        known = frame.select(F.when(F.col("known").isNull(), "nil").otherwise(F.col("key")).alias("key"),
                             utc_midnight(F.coalesce("known", "day")).alias("outcome_ts"), "actual")
        made.write.parquet(f"{tmp_dir}/made")
        known.write.parquet(f"{tmp_dir}/known")
        for _ in range(2):
            weekly_outcomes_stream(spark, f"{tmp_dir}/made", f"{tmp_dir}/known", f"{tmp_dir}/out", f"{tmp_dir}/ckpt",
                                   "30 days", "0 seconds").awaitTermination()
        got = {r.week_start: r for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
        late = {r.week_start: r.late for r in late_outcomes(made, known, "30 days").collect()}
        instants = weekly_metrics(made.withColumn("actual", F.lit(0)), "ts", "actual", "predicted").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == want and len(want) > 5
    assert sum(late.values()) == sum(i % 70 > 30 for i in range(140))
    assert {r.week_start for r in instants} >= set(want)


def test_rule_model_scores_like_the_rule(spark, table):
    model = evaluation.RuleModel("claim_pred", 3)
    got = models.predictions(model, models.model_input(table, models.SPEC_B), models.SPEC_B)
    rule = evaluation.rule_baseline(table).groupBy("claim_pred").count().collect()
    assert {(r.pred_label, r["count"]) for r in got.groupBy("pred_label").count().collect()} == {tuple(r) for r in rule}
    assert {max(r.probabilities.values()) for r in got.limit(50).collect()} == {1.0}


def test_all_evaluation_of_one_model_matches_brute_force(spark, monkeypatch):
    """The registered V2-V7 table against plain Python over the same predictions."""
    from conftest import SMALL
    from careops.plans import catalog
    made, make = [], catalog._claim_logistic_rows

    def kept(spark, sf_dir):
        made.append(make(spark, sf_dir).cache())
        return made[0]
    monkeypatch.setattr(catalog, "_claim_logistic_rows", kept)
    got = {(r.report, r.segment, r["item"], r.metric): r.value for r in catalog._model_evaluation(spark, SMALL).collect()}
    rows, classes = made[0].collect(), models.SPEC_B.classes

    def scores(some):
        """(volume, accuracy, weighted F1, recall of the last class)"""
        hits = sum(r.claim_label == r.pred_label for r in some)
        f1, recall = 0.0, None
        for k in range(3):
            tp = sum(r.claim_label == r.pred_label == k for r in some)
            actual, guessed = sum(r.claim_label == k for r in some), sum(r.pred_label == k for r in some)
            f1 += 2 * tp / (actual + guessed) * actual if actual + guessed else 0
            recall = tp / actual if actual else None
        return len(some), hits / len(some), f1 / len(some), recall

    for i, actual in enumerate(classes):
        mine = [r for r in rows if r.claim_label == i]
        for j, guess in enumerate(classes):
            share = sum(r.pred_label == j for r in mine) / len(mine)
            assert got["confusion", None, actual, f"pred_{guess}"] == pytest.approx(share, abs=1e-6)
        assert got["classes", None, actual, "support"] == len(mine)
    billed = sum(r.billed_amount for r in rows if r.claim_label == 2)
    flagged = sum(r.billed_amount for r in rows if r.claim_label == 2 and r.pred_label == 2)
    assert got["revenue", None, None, "total_rejected_billed"] == pytest.approx(float(billed))
    assert got["revenue", None, None, "flagged_rejected_billed"] == pytest.approx(float(flagged))
    assert got["revenue", None, None, "flagged_pct"] == pytest.approx(float(flagged) * 100 / float(billed), abs=1e-4)
    for segment in ("gender", "city", "insurance_provider"):
        for value in {r[segment] for r in rows if r[segment] is not None}:
            want = scores([r for r in rows if r[segment] == value])
            have = tuple(got["fairness", segment, value, m] for m in ("volume", "accuracy", "weighted_f1", "positive_recall"))
            assert have == pytest.approx(want, abs=2e-6) if want[3] is not None else (have[3] is None and have[:3] == pytest.approx(want[:3], abs=2e-6))
    made[0].unpersist()


def test_forest_search_tabulates_points_and_refits_the_best(spark, table):
    data = models.model_input(table, models.SPEC_A).where("split = 'train'")
    values = {"numTrees": [2, 4], "maxDepth": [2, 4], "minInstancesPerNode": [1]}
    found, model = models.search_forest(data, models.SPEC_A, values)
    assert {(r["numTrees"], r["maxDepth"], r["fold"]) for r in found} == {(n, d, f) for n in (2, 4) for d in (2, 4) for f in range(3)}
    for n, d in ((2, 2), (4, 4)):
        assert sum(r["rows"] for r in found if (r["numTrees"], r["maxDepth"]) == (n, d)) == data.count()
    mean = {(n, d): sum(r["accuracy"] for r in found if (r["numTrees"], r["maxDepth"]) == (n, d)) / 3 for n in (2, 4) for d in (2, 4)}
    stage = model.stages[-1]
    assert mean[stage.getNumTrees, stage.getOrDefault("maxDepth")] == pytest.approx(max(mean.values()))
