"""Writing tables.

* S3 reset and reload, S4 cascade delete: the three tables are written to a new folder,
  parents first, and published by one row each in a manifest that is written
  last; a reader of :func:`read_snapshot` sees all old or all new tables.
* S5 layout in place of the reference's secondary indexes: range
  partitioning plus a sort inside each file so parquet min/max statistics
  skip row groups for filters on visit_date, department, claim_status and
  insurance_provider; visits are also partitioned by year on disk.  Visits
  are ordered by the interleaved bits of visit date and department, so a
  filter on either alone skips most of them.  The range
  keys end in the table's key, so that a value with most rows spans many files.
  Files are sized by bytes.
* S7 model-table export partitioned by split; S10 drift-report sink.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops.functions.ranks import bucket_of

TABLES = ("patients", "visits", "billing")
LAYOUT = {
    "patients": (["insurance_provider", "patient_id"], ["insurance_provider", "patient_id"], []),
    "visits": (["_z", "visit_id"], ["_z", "visit_date", "department"], ["visit_year"]),
    "billing": (["claim_status", "bill_id"], ["claim_status", "bill_id"], []),
}
FILE_BYTES = 128 << 20  # of a file, before compression
Z_BITS = 5              # of each column's rank in the interleaved key


def interleaved(df: DataFrame, columns: tuple[str, ...], bits: int = Z_BITS) -> Column:
    """The bits of the columns' rank codes by turns, the leading ones first.

    A rank code is one of 2**bits ranges with about equal numbers of rows (NULL: 0);
    its edges are quantiles of numbers and dates, and evenly spaced among the
    distinct values of texts with up to a thousand of them.
    """
    codes = []
    for c in columns:
        kind = df.schema[c].dataType
        shares = [i / 2 ** bits for i in range(1, 2 ** bits)]
        if isinstance(kind, T.StringType):
            known = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(1000).collect())
            edges = sorted({known[int(x * len(known))] for x in shares}) if known else []
            value = F.col(c)
        else:
            value = F.unix_date(c) if isinstance(kind, T.DateType) else F.col(c).cast("double")
            edges = sorted(set(df.agg(F.percentile_approx(value, shares, 1000)).first()[0] or []))
        # few edges are spread over all codes, so that the leading bits tell them apart
        spread = F.floor(bucket_of(value, edges, strict=False) * F.lit(2 ** bits / (len(edges) + 1))).cast("int")
        codes.append(F.coalesce(spread, F.lit(0)))
    key = F.lit(0)
    for bit in reversed(range(bits)):
        for code in codes:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(code, bit).bitwiseAND(F.lit(1)))
    return key


def file_count(df: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Files for a table by its rows and the width of its columns (texts count 20 bytes)."""
    width = {T.StringType: 20, T.IntegerType: 4, T.DateType: 4}
    return max(1, -(-df.count() * sum(width.get(type(f.dataType), 8) for f in df.schema.fields) // file_bytes))


def write_table(df: DataFrame, path: str, table: str, files: int | None = None) -> None:
    """Range-partition on the filter columns, sort inside files, optional directory partitioning."""
    range_cols, sort_cols, part_cols = LAYOUT[table]
    columns = df.columns
    if "visit_year" in part_cols:
        df = df.withColumn("visit_year", F.year("visit_date"))
    if "_z" in range_cols:
        df = df.withColumn("_z", interleaved(df, ("visit_date", "department")))
    laid = df.repartitionByRange(files or file_count(df), *range_cols).sortWithinPartitions(*part_cols, *sort_cols)
    w = laid.select(*columns, *part_cols).write.mode("overwrite")
    if part_cols:
        w = w.partitionBy(*part_cols)
    w.parquet(path)


_MANIFEST = "version long, table_name string, path string"


def read_manifest(spark: SparkSession, base: str) -> DataFrame:
    """(version, table_name, path) of every published table."""
    return spark.read.schema(_MANIFEST).option("ignoreMissingFiles", True).json(f"{base.rstrip('/')}/manifest")


def _published(spark: SparkSession, base: str) -> int:
    try:
        return read_manifest(spark, base).agg(F.max("version")).first()[0] or 0
    except Exception as e:  # noqa: BLE001 - nothing was published yet
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def reload_tables(tables: dict[str, DataFrame], base: str) -> dict[str, str]:
    """S3: write patients, visits and billing to new folders, then publish them together; returns their paths.

    The manifest's rows for a version are one file, which Spark's commit makes
    visible as a whole, so a reader never sees tables of two versions.  Earlier
    versions stay readable until they are removed.
    """
    base = base.rstrip("/")
    spark = tables["patients"].sparkSession
    version = _published(spark, base) + 1
    folder = f"{base}/tables/{version}-{uuid.uuid4().hex[:8]}"
    paths = {name: f"{folder}/{name}" for name in TABLES}
    for name in TABLES:
        write_table(tables[name], paths[name], name)
    rows = [(version, name, paths[name]) for name in TABLES]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").json(f"{base}/manifest")
    return paths


def read_snapshot(spark: SparkSession, base: str, version: int | None = None) -> dict[str, DataFrame]:
    """The three tables of the newest published version, or of a given one."""
    rows = read_manifest(spark, base).collect()  # three for each version
    version = version or max((r["version"] for r in rows), default=None)
    paths = {r["table_name"]: r["path"] for r in rows if r["version"] == version}
    if set(paths) != set(TABLES):
        raise ValueError(f"{base}: no published version {version or ''}")
    return {name: spark.read.parquet(paths[name]).drop("visit_year") for name in TABLES}


def export_model_table(df: DataFrame, path: str) -> None:
    """Model table (train and test together) partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_drift_report(report: DataFrame, path: str) -> None:
    """The drift report (a handful of rows) as one headered CSV file."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
