"""Plan facts: anti-joins, joins that the planner broadcasts, pushdown, no global windows, constant plan sizes."""

from pyspark.sql import functions as F

from conftest import SMALL
from careops.operators import features, quality
from careops.sources.fixtures import read_table
from careops.sources.master import load_joined


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orphan_check_is_an_anti_join(hospital):
    p = plan(quality.visits_without_bill(hospital["visits"], hospital["billing"]))
    assert "LeftAnti" in p


def test_rate_mapping_broadcasts_checked_small_side(hospital):
    m = load_joined(hospital["patients"], hospital["visits"], hospital["billing"])
    aggs = features.fit_aggregates(m)
    out = features.transform_features(m, aggs)
    assert "BroadcastHashJoin" in plan(out)


def test_split_tags_rows_without_a_window(hospital):
    m = load_joined(hospital["patients"], hospital["visits"], hospital["billing"])
    split = features.time_split(m)
    p = plan(split.select("visit_id", "split"))
    assert "Window" not in p


def test_filters_and_columns_reach_the_scan(spark):
    o = read_table(spark, SMALL, "orders").where(F.col("o_orderdate") >= "1996-01-01").select("o_orderkey")
    p = o._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_the_three_table_join_runs_once(spark, monkeypatch):
    """Split, fitted rates and features read one checkpoint: lineitem is scanned for that alone."""
    from careops.functions import ranks
    from careops.plans import catalog
    plans, cut = [], features.cut_lineage

    def recorded(df):
        plans.append(plan(df))
        return cut(df)
    for module in (features, ranks, catalog):
        monkeypatch.setattr(module, "cut_lineage", recorded)
    for query in (catalog.model_table, catalog._split, catalog._train_aggs, catalog._scored, catalog._triggers):
        plans.clear()
        last = plan(query(spark, SMALL))
        assert sum("lineitem.parquet" in p for p in plans) == 1 and "lineitem.parquet" not in last


def test_gate_keeps_rows_without_a_bill(spark):
    from careops.operators import governance
    active = spark.createDataFrame([(1, 10, 0, 0), (2, None, 1, 0)], "visit_id long, bill_id long, y int, p int")
    candidate = active.withColumn("p", F.col("y"))
    r = governance.promotion_gate(active, candidate, ["visit_id", "bill_id"], "y", "p").first()
    assert (r.rows, r.active_accuracy, r.candidate_accuracy, r.promote) == (2, 0.5, 1.0, True)


def test_rows_without_a_department_keep_a_missing_stay(spark):
    from careops.operators import profiling
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 5.0), (None, None)],
                               "department string, length_of_stay_hours double").selectExpr(
        "*", "CAST(NULL AS DECIMAL(10,2)) AS approved_amount", "CAST(NULL AS INT) AS payment_days")
    got = sorted((r.department or "", r.length_of_stay_hours or -1) for r in profiling.impute(df).collect())
    assert got == [("", -1), ("", 5.0), ("a", 1.0), ("a", 2.0), ("a", 3.0)]


def test_rows_stay_dealt_when_few_valued_lookups_are_joined(spark, hospital):
    """Rates, frame means and class weights have a handful of keys: the rows must not be dealt by them."""
    from careops.operators import models
    from careops.session import cut_lineage
    from careops.sources.master import load_joined
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        table = features.model_table(load_joined(hospital["patients"], hospital["visits"], hospital["billing"]))
        labelled = cut_lineage(spark.range(20_000).withColumn("y", F.col("id") % 3).repartition(40))
        for out in (table, models.balanced_weights(labelled, "y")):
            # looked-up columns are summed too: a join that none is read from is dropped
            sums = [F.sum(c) for c, kind in out.dtypes if kind == "double"]
            sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), *sums).collect()]
            assert max(sizes) < 0.1 * sum(sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rates_of_a_stream_are_computed_once(spark, monkeypatch):
    from careops.functions import joins
    from careops.operators import scoring
    calls, cut = [], joins.cut_lineage
    monkeypatch.setattr(joins, "cut_lineage", lambda df: calls.append(1) or cut(df))
    rates = features.Aggregates(spark.createDataFrame([("a", 0.5)], "insurance_provider string, provider_rejection_rate double"),
                                spark.createDataFrame([("d", 0.25)], "department string, revenue_realization_rate_dept double"),
                                spark.createDataFrame([(0.1, 0.9)], "global_rejection double, global_realization double"))
    enrich = scoring.claim_enricher(rates)
    for provider, rate in (("a", 0.5), ("z", 0.1)):
        batch = spark.createDataFrame([(provider, "d")], "insurance_provider string, department string")
        assert tuple(enrich(batch).select("provider_rejection_rate", "revenue_realization_rate_dept").first()) == (rate, 0.25)
    assert len(calls) == 2


def test_rows_are_prepared_once_for_fit_and_scoring(spark):
    """The preprocessing of all rows is stored: neither the scoring nor a pass of a fit repeats it."""
    from careops.operators import models
    from careops.plans import catalog
    for query in (catalog._risk_logistic, catalog._claim_logistic, catalog._claim_logistic_rows):
        p = plan(query(spark, SMALL))
        assert "__idx" not in p and "__ohe" not in p
    indexers = [s for s in models.preprocessing(models.SPEC_B) if "StringIndexer" in type(s).__name__]
    assert len(indexers) == 1  # one pass for all categorical columns
    labelled = spark.range(100).withColumn("y", F.col("id") % 3)
    assert "Range" not in plan(models.class_weights(labelled, "y"))  # weights read the counts, not the rows again
