"""CSV ingest, table layout, checkpoint folder, audit ids, cached frames."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from careops import schema as S
from careops import session
from careops.operators import models, scoring
from careops.plans.catalog import QUERIES
from careops.sources import audit, csv_ingest, layout

from conftest import SMALL


def _csv(tmp_dir, text):
    with open(f"{tmp_dir}/t.csv", "w", newline="") as f:
        f.write(text)
    return f"{tmp_dir}/t.csv"


def test_csv_columns_are_found_by_name(spark, tmp_dir):
    path = _csv(tmp_dir, "gender,age,extra,patient_id,city,insurance_provider,chronic_flag,registration_date\n"
                         "M,44,x,7,Oslo,Acme,1,2020-01-02\n")
    r = csv_ingest.read_typed_csv(spark, path, S.PATIENTS).first()
    assert (r.patient_id, r.age, r.gender, r.city, r.chronic_flag) == (7, 44, "M", "Oslo", 1)
    with pytest.raises(ValueError, match="city"):
        csv_ingest.read_typed_csv(spark, _csv(tmp_dir, "patient_id,age\n1,2\n"), S.PATIENTS)


def test_csv_integers_with_gaps_and_quoted_line_ends(spark, tmp_dir):
    path = _csv(tmp_dir, "bill_id,visit_id,billed_amount,approved_amount,claim_status,payment_days,billing_date\n"
                         '1,1,10.50,,"two\nlines, ""quoted""",5.0,2020-01-01\n'
                         "2,2,1,1,Paid,5.5,2020-01-01\n3,3,1,1,Paid,,2020-01-01\n4,4,1,1,Paid, 12 ,2020-01-01\n")
    rows = csv_ingest.read_typed_csv(spark, path, S.BILLING).orderBy("bill_id").collect()
    assert [r.payment_days for r in rows] == [5, None, None, 12]
    assert rows[0].claim_status == 'two\nlines, "quoted"' and rows[0].approved_amount is None


def test_layout_spreads_a_hot_value(spark, tmp_dir):
    rows = spark.range(20_000).select(
        F.col("id").alias("bill_id"), F.col("id").alias("visit_id"), F.lit(1).cast("decimal(10,2)").alias("billed_amount"),
        F.lit(None).cast("decimal(10,2)").alias("approved_amount"),
        F.when(F.col("id") % 100 < 65, "Paid").otherwise("Pending").alias("claim_status"),
        F.lit(1).alias("payment_days"), F.current_date().alias("billing_date"))
    layout.write_table(rows, f"{tmp_dir}/billing", "billing", files=16)
    back = spark.read.parquet(f"{tmp_dir}/billing")
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    assert back.count() == 20_000


def test_cluster_needs_a_shared_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_missing_and_null_request_fields_hash_alike_only_if_written(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "age long, city string")
    texts = [r.j for r in df.select(scoring.request_json(["age", "city"]).alias("j")).collect()]
    assert texts == ['{"age":1,"city":null}', '{"age":null,"city":"x"}']


def test_audit_ids_do_not_depend_on_partitions(spark):
    df = spark.range(50).select(F.col("id").alias("age"), F.lit("Paid").alias("predicted_class"),
                                F.lit("v").alias("model_version"))
    ids = [{r.row_id for r in audit.audit_rows(df.repartition(n), "/predict/claim", 0, ["age"]).collect()} for n in (1, 7)]
    assert ids[0] == ids[1] and len(ids[0]) == 50


def test_audit_tail_reads_the_newest_batches(spark, tmp_dir):
    df = spark.range(6).select(F.col("id").alias("age"), F.lit("Paid").alias("predicted_class"),
                               F.lit("v").alias("model_version"))
    for b in range(4):
        audit.append_audit(audit.audit_rows(df, "/predict/claim", b, ["age"]), f"{tmp_dir}/audit")
    tail = audit.audit_tail(spark, f"{tmp_dir}/audit", "age long")
    assert sorted(r.batch_id for r in tail.collect()) == [2] * 4 + [3] * 6


def test_every_row_is_scored(spark):
    rows = [(i, float(i % 5) if i % 3 else None, "a" if i % 2 else None, float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "visit_id long, x double, c string, y double")
    spec = models.FeatureSpec("y", ("p", "q", "r"), ("x",), ("c",), ())
    data = models.model_input(df, spec)
    got = models.predictions(models.logistic(spec, 60).fit(data), data, spec).collect()
    assert len(got) == 60 and sum(r.n_filled for r in got) == 20
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 for r in got)
    assert all(r.predicted_class == max(r.probabilities, key=r.probabilities.get) for r in got)


@pytest.mark.parametrize("name", ["e03_iqr_outliers", "f06_f12_model_table", "f13_current_aggregates", "k05_drift_report",
                                  "v02_report_risk_rule", "c03_claim_enrichment", "s02_key_contract"])
def test_queries_leave_no_cached_frame(spark, name):
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    QUERIES[name](spark, SMALL).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert set(E.queries()) >= set(QUERIES)


def _visits(spark, n=24_000):
    return spark.range(n).selectExpr(
        "id AS visit_id", "id % 77 AS patient_id", "date_add(DATE '2020-01-01', CAST(id * 7919 % 730 AS INT)) AS visit_date",
        "element_at(array('A', 'B', 'C', 'D', 'E'), CAST(id * 31 % 5 + 1 AS INT)) AS department", "'OPD' AS visit_type",
        "CAST(1 AS DECIMAL(10,2)) AS length_of_stay_hours", "'Low' AS risk_score", "1 AS doctor_id")


def _file_ranges(path, column):
    """(least, greatest) of a column for each file, from the parquet footers."""
    import glob

    import pyarrow.parquet as pq
    out = []
    for f in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.read_metadata(f)
        i = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == column)
        stats = [meta.row_group(g).column(i).statistics for g in range(meta.num_row_groups)]
        out.append((min(s.min for s in stats), max(s.max for s in stats)))
    return out


def test_a_filter_on_either_column_skips_most_files(spark, tmp_dir):
    import datetime as dt
    layout.write_table(_visits(spark), f"{tmp_dir}/visits", "visits", files=64)
    days, wards = _file_ranges(f"{tmp_dir}/visits", "visit_date"), _file_ranges(f"{tmp_dir}/visits", "department")
    day = dt.date(2020, 6, 15)
    assert sum(a <= day <= b for a, b in days) < len(days) / 4
    assert sum(a <= "C" <= b for a, b in wards) < len(wards) / 2
    assert spark.read.parquet(f"{tmp_dir}/visits").count() == 24_000


def test_files_are_sized_by_bytes(spark):
    visits = _visits(spark, 1000)
    assert layout.file_count(visits) == 1
    assert layout.file_count(visits, file_bytes=10_000) == -(-1000 * (8 + 8 + 4 + 20 + 20 + 8 + 20 + 4) // 10_000)


def test_readers_see_whole_snapshots(spark, hospital, tmp_dir):
    t = {n: hospital[n] for n in layout.TABLES}
    with pytest.raises(ValueError, match="no published version"):
        spark.createDataFrame([], layout._MANIFEST).write.json(f"{tmp_dir}/empty/manifest")
        layout.read_snapshot(spark, f"{tmp_dir}/empty")
    base = f"{tmp_dir}/base"
    layout.reload_tables(t, base)
    first = {n: layout.read_snapshot(spark, base)[n].count() for n in layout.TABLES}
    assert first == {n: t[n].count() for n in layout.TABLES}
    # a second version half written: nothing of it is seen before its manifest row
    fewer = {n: df.limit(10) for n, df in t.items()}
    layout.write_table(fewer["patients"], f"{base}/tables/2-half/patients", "patients")
    seen = layout.read_snapshot(spark, base)
    assert {n: seen[n].count() for n in layout.TABLES} == first
    layout.reload_tables(fewer, base)
    assert {n: df.count() for n, df in layout.read_snapshot(spark, base).items()} == {n: 10 for n in layout.TABLES}
    # a reader that opened the first version still reads it
    assert {n: seen[n].count() for n in layout.TABLES} == first
    assert layout.read_snapshot(spark, base, 1)["visits"].count() == first["visits"]


def test_tail_reads_only_the_newest_folders(spark, tmp_dir):
    df = spark.range(6).select(F.col("id").alias("age"), F.lit("Paid").alias("predicted_class"), F.lit("v").alias("model_version"))
    for b in (0, 1, 2, 10, 11):
        audit.append_audit(audit.audit_rows(df, "/predict/claim", b, ["age"]), f"{tmp_dir}/audit")
    tail = audit.audit_tail(spark, f"{tmp_dir}/audit", "age long")
    assert {f.split("batch_id=")[1].split("/")[0] for f in tail.inputFiles()} == {"10", "11"}
    counts = {r.batch_id: r.n for r in spark.read.parquet(f"{tmp_dir}/audit_manifest").collect()}
    assert counts == dict.fromkeys((0, 1, 2, 10, 11), 6)


def test_csv_files_are_split_unless_cells_hold_line_ends(spark, tmp_dir):
    plain = _csv(tmp_dir, 'a,b\n1,"x, ""y"""\n')
    assert not csv_ingest.has_quoted_line_ends(spark, plain)
    assert csv_ingest.has_quoted_line_ends(spark, _csv(tmp_dir, 'a,b\n1,"x\ny"\n'))
