"""Map the driver's TPC-H style tables onto patients / visits / billing.

The mapping (FIXTURES.md part 3) plants faults on purpose: blank / 'null' /
NULL insurance providers, NULL and zero lengths of stay, negative and missing
payment days.  The staging tables hold two more: patients that arrive twice, and
visits that are missing so that their bills are orphans.
Every row of customer / orders / lineitem flows through, so the derived
tables grow with the inputs.

``FIXTURE_CTE`` is the same mapping as one SQL ``WITH`` prefix that DuckDB
runs for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careops.functions.joins import spread

ORDER_LINES = 4  # line items of an order, about


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def patients_from(customer: DataFrame, nation: DataFrame) -> DataFrame:
    cust = customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nat = nation.select(F.col("n_nationkey"), F.col("n_name"))
    joined = cust.join(nat, cust["c_nationkey"] == nat["n_nationkey"])
    return joined.selectExpr(
        "c_custkey AS patient_id",
        "CAST(18 + c_custkey % 73 AS INT) AS age",
        "CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender",
        "n_name AS city",
        "CASE WHEN c_custkey % 101 = 100 THEN NULL WHEN c_custkey % 103 = 102 THEN '' "
        "WHEN c_custkey % 107 = 106 THEN 'null' ELSE c_mktsegment END AS insurance_provider",
        "CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INT) AS chronic_flag",
        "date_add(DATE '1995-01-01', CAST(c_custkey % 400 AS INT)) AS registration_date",
    )


def visits_from(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS visit_id",
        "o_custkey AS patient_id",
        "CAST(o_orderdate AS DATE) AS visit_date",
        "o_orderpriority AS department",
        "CASE o_orderstatus WHEN 'F' THEN 'OPD' WHEN 'O' THEN 'ER' ELSE 'ICU' END AS visit_type",
        "CASE WHEN o_orderkey % 50 = 7 THEN NULL "
        "WHEN o_orderkey % 211 = 5 THEN CAST(0 AS DECIMAL(10,2)) "
        "ELSE CAST(1.0 + (o_orderkey * 37 % 4700) / 100.0 AS DECIMAL(10,2)) END "
        "AS length_of_stay_hours",
        "CASE WHEN o_totalprice >= 400000 THEN 'High' WHEN o_totalprice >= 250000 "
        "THEN 'Medium' ELSE 'Low' END AS risk_score",
        "CAST(o_orderkey % 120 AS INT) AS doctor_id",
    )


def billing_from(lineitem: DataFrame) -> DataFrame:
    # One bill per order: a hash aggregate on l_orderkey, with map-side partial sums unless the table is so large that
    # load_hospital deals it by l_orderkey (then a task's sums are of its own orders only, however large the files).
    # The money sums are exact sums of unscaled longs (cents, and cents x hundredths),
    # turned back into decimals once per order -- the same values as summing the
    # DECIMAL(10,2) / DECIMAL(16,4) products, without wide-decimal arithmetic per row.
    cents = "CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * 100 AS BIGINT)"
    keep = "CAST((1 - CAST(l_discount AS DECIMAL(4,2))) * 100 AS BIGINT)"
    per_order = lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.expr(f"CAST(CAST(SUM({cents}) AS DECIMAL(20,0)) / 100 AS DECIMAL(10,2))").alias("billed"),
        F.expr(f"CAST(CAST(SUM({cents} * {keep}) AS DECIMAL(20,0)) / 10000 AS DECIMAL(10,2))")
        .alias("approved"),
        F.expr("CASE WHEN SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 2 > COUNT(*) "
               "THEN 'Rejected' WHEN SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) * 2 "
               "> COUNT(*) THEN 'Pending' ELSE 'Paid' END").alias("status"),
        F.expr("CAST(MAX(l_shipdate) AS DATE)").alias("billing_date"),
    )
    return per_order.selectExpr(
        "k AS bill_id",
        "k AS visit_id",
        "billed AS billed_amount",
        "CASE WHEN status = 'Paid' THEN approved "
        "WHEN status = 'Rejected' AND k % 2 = 1 THEN CAST(0 AS DECIMAL(10,2)) END AS approved_amount",
        "status AS claim_status",
        "CASE WHEN status = 'Paid' AND k % 199 <> 3 THEN "
        "CAST(CASE WHEN k % 307 = 11 THEN -1 ELSE k % 30 END AS INT) END AS payment_days",
        "billing_date",
    )


def staging_patients_from(patients: DataFrame) -> DataFrame:
    """Patients as staged before the key contract: some rows arrive twice."""
    return patients.unionByName(patients.where("patient_id % 500 = 3"))


def staging_visits_from(visits: DataFrame) -> DataFrame:
    """Visits as staged before the key contract: some are missing, and their bills are orphans."""
    return visits.where("visit_id % 97 <> 13")


def load_hospital(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """patients / visits / billing (+ staging_patients, staging_visits) derived from the driver tables."""
    patients = patients_from(read_table(spark, sf_dir, "customer"),
                             read_table(spark, sf_dir, "nation"))
    visits = visits_from(read_table(spark, sf_dir, "orders"))
    lineitem = read_table(spark, sf_dir, "lineitem")
    return {
        "patients": patients,
        "visits": visits,
        "billing": billing_from(spread(lineitem, lineitem.count(), ["l_orderkey"], ORDER_LINES)),
        "staging_patients": staging_patients_from(patients),
        "staging_visits": staging_visits_from(visits),
    }


PATIENTS_SQL = """SELECT c_custkey AS patient_id, CAST(18 + c_custkey % 73 AS INT) AS age,
  CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, n_name AS city,
  CASE WHEN c_custkey % 101 = 100 THEN NULL WHEN c_custkey % 103 = 102 THEN ''
       WHEN c_custkey % 107 = 106 THEN 'null' ELSE c_mktsegment END AS insurance_provider,
  CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INT) AS chronic_flag,
  CAST(DATE '1995-01-01' + CAST(c_custkey % 400 AS INT) AS DATE) AS registration_date
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

VISITS_SQL = """SELECT o_orderkey AS visit_id, o_custkey AS patient_id, CAST(o_orderdate AS DATE) AS visit_date,
  o_orderpriority AS department,
  CASE o_orderstatus WHEN 'F' THEN 'OPD' WHEN 'O' THEN 'ER' ELSE 'ICU' END AS visit_type,
  CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 211 = 5 THEN CAST(0 AS DECIMAL(10,2))
       ELSE CAST(1.0 + (o_orderkey * 37 % 4700) / 100.0 AS DECIMAL(10,2)) END AS length_of_stay_hours,
  CASE WHEN o_totalprice >= 400000 THEN 'High' WHEN o_totalprice >= 250000 THEN 'Medium' ELSE 'Low' END AS risk_score,
  CAST(o_orderkey % 120 AS INT) AS doctor_id
FROM orders"""

BILLING_SQL = """SELECT k AS bill_id, k AS visit_id, billed AS billed_amount,
  CASE WHEN status = 'Paid' THEN approved
       WHEN status = 'Rejected' AND k % 2 = 1 THEN CAST(0 AS DECIMAL(10,2)) END AS approved_amount,
  status AS claim_status,
  CASE WHEN status = 'Paid' AND k % 199 <> 3
       THEN CAST(CASE WHEN k % 307 = 11 THEN -1 ELSE k % 30 END AS INT) END AS payment_days, billing_date
FROM (SELECT l_orderkey AS k,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(10,2))) AS DECIMAL(10,2)) AS billed,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(10,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(10,2)) AS approved,
  CASE WHEN SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 2 > COUNT(*) THEN 'Rejected'
       WHEN SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) * 2 > COUNT(*) THEN 'Pending' ELSE 'Paid' END AS status,
  CAST(MAX(l_shipdate) AS DATE) AS billing_date
  FROM lineitem GROUP BY l_orderkey) t"""

STAGING_PATIENTS_SQL = """SELECT * FROM patients UNION ALL SELECT * FROM patients WHERE patient_id % 500 = 3"""

STAGING_VISITS_SQL = """SELECT * FROM visits WHERE visit_id % 97 <> 13"""

FIXTURE_CTE = (
    f"WITH patients AS ({PATIENTS_SQL}),\n"
    f"visits AS ({VISITS_SQL}),\n"
    f"billing AS ({BILLING_SQL}),\n"
    f"staging_patients AS ({STAGING_PATIENTS_SQL}),\n"
    f"staging_visits AS ({STAGING_VISITS_SQL})"
)


def with_fixtures(extra_ctes: str, body: str) -> str:
    """Compose an oracle query: fixture CTEs, optional further CTEs, then the body."""
    ctes = FIXTURE_CTE + ("," + extra_ctes if extra_ctes else "")
    return f"{ctes}\n{body}"
