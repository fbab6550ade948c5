"""Large tables are dealt to more tasks than the session's shuffle partitions."""
import glob

from conftest import SMALL
from pyspark.sql import functions as F

from careops.functions import joins
from careops.operators import features
from careops.plans import catalog
from careops.sources import fixtures


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_of_the_model_table_do_not_grow_with_the_rows(spark, monkeypatch):
    expected = catalog.model_table(spark, SMALL).orderBy("visit_id", "bill_id").collect()
    monkeypatch.setattr(joins, "TASK_ROWS", 25, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the patients were many
    try:
        bills = fixtures.load_hospital(spark, SMALL)["billing"]
        assert bills.count() > 1000 and largest_task(bills) < 75  # over 1000 / 8 partitions before
        table = catalog.model_table(spark, SMALL)
        assert largest_task(table) < 100
        assert table.orderBy("visit_id", "bill_id").collect() == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_frames_keep_the_shuffle_partitions(spark):
    df = spark.range(100)
    assert joins.spread(df, 100, ["id"]) is df
    rates = features.transform_features(catalog._master(spark, SMALL), None)
    assert "REPARTITION_BY_NUM" not in rates._jdf.queryExecution().toString()


def test_request_files_of_the_stream_do_not_follow_the_tasks(spark, monkeypatch, tmp_dir):
    monkeypatch.setattr(joins, "TASK_ROWS", 25, raising=False)
    monkeypatch.setattr(catalog, "REQUEST_ROWS", 125)
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: tmp_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = catalog.QUERIES["c06_risk_scoring_stream"](spark, SMALL)
        rows = out.groupBy("output").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = {r["output"]: r["count"] for r in rows}
    assert found["scored"] + found["rejects"] == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert found["audit"] == found["scored"]
    files = glob.glob(f"{tmp_dir}/requests/*.json")
    assert 12 < len(files) <= 2 * 12  # 60 tasks make the table
    assert len(glob.glob(f"{tmp_dir}/out/scored/batch_id=*")) <= 8
