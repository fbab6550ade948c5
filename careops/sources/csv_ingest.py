"""Typed CSV ingest.

Columns are found by header name and read as text first, then converted with ``try_cast`` so a bad
cell becomes NULL instead of failing the job (ANSI casts raise).  Missing
tokens follow pandas' default list exactly; blanks are NULL, never 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops import schema as S


def _convert(name: str, dtype: T.DataType):
    raw = F.col(f"`{name}`")
    missing = raw.isNull() | raw.isin(S.NA_TOKENS)
    if isinstance(dtype, T.StringType):
        value = raw
    else:
        value = F.trim(raw).try_cast(dtype)
        if isinstance(dtype, T.IntegralType):
            # an integer column with gaps is written as 5.0
            number = F.trim(raw).try_cast("decimal(38,10)")
            value = F.coalesce(value, F.when(number == F.floor(number), number.try_cast(dtype)))
    return F.when(missing, F.lit(None).cast(dtype)).otherwise(value).alias(name)


def has_quoted_line_ends(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, so that a cell goes on in the next one (files are split for this)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool | None = None) -> DataFrame:
    """Read headed CSV as text, take the schema's columns by name, coerce each to its declared type.

    Further columns are ignored; a missing one is an error.  With
    ``multi_line`` a quoted cell may hold line ends; files are then not split,
    so it is on only where :func:`has_quoted_line_ends` finds any, if not given.
    """
    if multi_line is None:
        multi_line = has_quoted_line_ends(spark, path)
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False)
           .option("nullValue", None).option("emptyValue", "").option("escape", '"')
           .option("multiLine", multi_line).csv(path))
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return raw.select(*[_convert(f.name, f.dataType) for f in schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as headered CSV (NULL as an empty field)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def ingest_hospital_csv(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The three tables from ``<base>/<table>/`` CSV folders with their declared schemas."""
    return {name: read_typed_csv(spark, f"{base.rstrip('/')}/{name}", sch) for name, sch in S.TABLES.items()}
