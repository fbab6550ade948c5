"""Key contract (S2) and cascade delete.

The reference leans on database constraints: duplicate primary keys and
dangling foreign keys are refused, and deleting a patient cascades to
visits and then bills.  Here the same contract is applied to DataFrames:

* PK: one row per key survives, chosen deterministically as the smallest
  row (``min(struct(...))`` aggregate, so a key with a huge number of
  copies is collapsed by map-side partial aggregation, never gathered in
  one task); the extra copies are rejected.
* FK: ``left_semi`` keeps children whose parent exists, ``left_anti``
  rejects the rest.
* Cascade: anti-joins remove the deleted parents' children level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_primary_key(df: DataFrame, key: str) -> DataFrame:
    """Keep one row per ``key`` (the smallest by all columns)."""
    others = [c for c in df.columns if c != key]
    if not others:
        return df.select(key).distinct()
    kept = df.groupBy(key).agg(F.min(F.struct(*others)).alias("_row"))
    return kept.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def pk_duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """Per key, how many copies beyond the first were rejected."""
    return (df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("rejected_copies"))
            .where("rejected_copies > 0"))


@dataclass
class KeyedTables:
    patients: DataFrame
    visits: DataFrame
    billing: DataFrame
    rejected_visits: DataFrame
    rejected_billing: DataFrame


def _check_fk(child: DataFrame, parent: DataFrame, fk: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) children; a NULL foreign key is allowed, as in SQL."""
    keys = parent.select(F.col(fk).alias("_key")).distinct()
    marked = child.join(keys, F.col(fk) == F.col("_key"), "left")
    known = F.col("_key").isNotNull() | F.col(fk).isNull()
    return marked.where(known).drop("_key"), marked.where(~known).drop("_key")


def enforce_keys(patients: DataFrame, visits: DataFrame, billing: DataFrame) -> KeyedTables:
    """Apply PK uniqueness to all three tables and FKs visits->patients, billing->visits."""
    p = dedupe_primary_key(patients, "patient_id")
    v_pk = dedupe_primary_key(visits, "visit_id")
    v, v_rej = _check_fk(v_pk, p, "patient_id")
    b_pk = dedupe_primary_key(billing, "bill_id")
    b, b_rej = _check_fk(b_pk, v, "visit_id")
    return KeyedTables(p, v.select(visits.columns), b.select(billing.columns),
                       v_rej.select(visits.columns), b_rej.select(billing.columns))


def _contract_row(name: str, staged: DataFrame, key: str, parent_keys: DataFrame | None = None,
                  fk: str | None = None) -> DataFrame:
    """One pass: copies per key (partial-aggregated), then parent lookup, then the three counts."""
    if fk is None:
        per_key = staged.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
        ok = F.lit(True)
    else:
        # the kept row per key decides the FK check; a NULL foreign key is allowed
        per_key = staged.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"),
                                          F.min(F.struct(*[c for c in staged.columns if c != key]))
                                          .getField(fk).alias("_fk"))
        parents = parent_keys.select(F.col(fk).alias("_fk"), F.lit(True).alias("_found")).distinct()
        per_key = per_key.join(parents, "_fk", "left")
        ok = F.col("_fk").isNull() | F.col("_found").isNotNull()
    agg = per_key.agg(F.sum("_copies").alias("staged_rows"), F.count(F.lit(1)).alias("_pk"),
                      F.count_if(ok).alias("accepted_rows"))
    return agg.select(F.lit(name).alias("table_name"), F.coalesce("staged_rows", F.lit(0)).alias("staged_rows"),
                      "accepted_rows", (F.coalesce("staged_rows", F.lit(0)) - F.col("_pk")).alias("rejected_pk"),
                      (F.col("_pk") - F.col("accepted_rows")).alias("rejected_fk"))


def key_contract_report(staging_patients: DataFrame, visits: DataFrame,
                        billing: DataFrame) -> DataFrame:
    """S2 summary: per table staged rows, accepted rows, PK and FK rejects (one pass per table)."""
    kt = enforce_keys(staging_patients, visits, billing)
    return (_contract_row("patients", staging_patients, "patient_id")
            .unionByName(_contract_row("visits", visits, "visit_id", kt.patients, "patient_id"))
            .unionByName(_contract_row("billing", billing, "bill_id", kt.visits, "visit_id")))


def cascade_delete(patients: DataFrame, visits: DataFrame, billing: DataFrame,
                   patient_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove ``patient_ids`` (a one-column DataFrame), their visits, then those visits' bills."""
    ids = patient_ids.select("patient_id").distinct()
    p = patients.join(ids, "patient_id", "left_anti")
    dead_visits = visits.join(ids, "patient_id", "left_semi").select("visit_id")
    v = visits.join(ids, "patient_id", "left_anti")
    b = billing.join(dead_visits, "visit_id", "left_anti")
    return p.select(patients.columns), v.select(visits.columns), b.select(billing.columns)


def cascade_report(patients: DataFrame, visits: DataFrame, billing: DataFrame,
                   patient_ids: DataFrame) -> DataFrame:
    """Rows before / after a cascade delete, per table."""
    ids = patient_ids.select("patient_id").distinct().withColumn("_dead", F.lit(True))
    dead_visits = visits.join(ids, "patient_id", "left_semi").select("visit_id").distinct() \
        .withColumn("_dead", F.lit(True))

    def row(name, before, marks, key):
        tagged = before.join(marks, key, "left")
        agg = tagged.agg(F.count(F.lit(1)).alias("rows_before"),
                         F.count_if(F.col("_dead").isNull()).alias("rows_after"))
        return agg.select(F.lit(name).alias("table_name"), "rows_before", "rows_after",
                          (F.col("rows_before") - F.col("rows_after")).alias("rows_deleted"))

    # one tagging pass per table (same rows as cascade_delete keeps)
    return (row("patients", patients, ids, "patient_id")
            .unionByName(row("visits", visits, ids, "patient_id"))
            .unionByName(row("billing", billing, dead_visits, "visit_id")))
