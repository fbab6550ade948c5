"""Null-safe equi-joins, joins to lookup tables, and the tasks of large ones.

Small sides of :func:`null_safe_join` are not broadcast by hand: the planner
does it where its size estimate allows, and adaptive execution where the
measured shuffle size does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careops.session import cut_lineage

LOOKUP_ROWS = 100_000  # rows up to which a lookup table is sent to the rows
TASK_ROWS = 250_000    # rows that a task joins or groups, where a table is dealt by its size


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the key columns come from ``left``."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def spread(df: DataFrame, rows: int, on: Sequence[str], rows_per_key: int = 1) -> DataFrame:
    """``df`` dealt by ``on`` to as many tasks as a table of ``rows`` rows needs; a join or an aggregate by ``on`` keeps
    them, and deals a join's other side alike.  Rows that an aggregate makes one of count once, about.

    The session's number of shuffle partitions is the same for any table, so a task would read and sort more with every
    row that comes.  A table for which that number is enough is left as it is.
    """
    tasks = -(-rows // (rows_per_key * TASK_ROWS))
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *on)


def lookup(table: DataFrame) -> DataFrame:
    """An aggregated lookup table, one row per key, as :func:`lookup_join` joins it: computed once for any number of joins."""
    table = cut_lineage(table)
    return F.broadcast(table) if table.count() <= LOOKUP_ROWS else table


def lookup_join(df: DataFrame, table: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Left join to an aggregated lookup table, one row per key.

    A table of few keys is sent to the rows.  Shuffled by the key, all rows would come to as many tasks as there
    are keys, and adaptive execution keeps it so: it does not broadcast a side most of whose partitions are empty.
    A table of more than LOOKUP_ROWS keys deals the rows well, and is shuffled.
    """
    return df.join(lookup(table), on, "left")
