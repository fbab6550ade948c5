"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careops.llm.common import WORD_RE, cut_lineage

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKET_ROWS = 10_000
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def _draw(text: Column) -> Column:
    """A number in [0, 2**32) from the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source: (source, source_size).

    Sources in code point order, null last, weigh ``weights``, repeating.  All
    sizes together are shared by weight; a source's target stops at
    ``max_copies`` times its size and the excess goes to the others by weight.
    With the sources in order of size per weight, those that stop are a
    prefix, so one running sum gives the share per unit of weight.  The window
    runs over one row per source.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    t = (sizes.withColumn("weight", weight.cast("double"))
         .withColumn("most", (F.col("source_size") * max_copies).cast("double"))
         .withColumn("total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("all_weight", F.sum("weight").over(everything)))
    order = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("share", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                      / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
         .withColumn("stops", F.col("most") <= F.col("share") * F.col("weight")))
    # the share of the first source that doesn't stop holds for all that don't; later ones are smaller
    level = F.max(F.when(~F.col("stops"), F.col("share"))).over(everything)
    return t.select("source", "source_size", F.when(F.col("stops"), F.col("most"))
                    .otherwise(level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED,
        bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """How often each document enters a mix whose sources meet their targets (see :func:`targets`).

    Returns one row per input row: ``doc_id``, ``source``, ``size`` (words),
    ``source_size``, ``target``, ``copies`` and the ``keep`` columns.  Every document of a source
    has the same expected number of copies, target / source_size, at most
    ``max_copies``.  A source's documents are put in a fixed order, their
    expected copies are summed along it from a random offset, and a document
    is emitted once per integer that its part of the sum crosses.

    The order is by hash bucket and, inside a bucket, by size, so that each
    stretch of it holds all sizes.  A bucket has about ``bucket_rows`` rows,
    of all sources, and a source's offset in a bucket is the running count of
    its rows in the buckets before; so a source with most rows is spread as
    evenly as the others.  The offset and the buckets come from md5, so reruns
    agree.

    A null or wordless text has size 0 and is emitted as often as its source's
    others; a source of size 0 has target 0 and emits nothing.  A null source
    is a source of its own.  Rows with a null id share a bucket and are told
    apart by size.  Repeated rows are documents of their own.  An empty table
    gives an empty result; other columns of ``docs`` are not looked at.
    """
    source = F.col(source_col).cast("string")
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("source_key"),  # null: a key of its own
        word_count(F.col(text_col).cast("string")).alias("size"),
        _draw(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))))
        .alias("draw"), *keep))
    buckets = max(1, -(-rows.count() // bucket_rows))
    keyed = rows.withColumn("bucket", (F.col("draw") % buckets).cast("int"))
    counts = cut_lineage(keyed.groupBy("source_key", "bucket").agg(
        F.first("source").alias("source"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")))
    sizes = counts.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("s").alias("source_size"))
    goals = targets(sizes, weights, max_copies).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"), "source_size", "target")
    ahead = F.sum("n").over(Window.partitionBy("source_key").orderBy("bucket")
                            .rowsBetween(Window.unboundedPreceding, -1))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _draw(F.concat(F.lit(f"{seed}:offset:"), F.col("source_key"))) / F.lit(2.0 ** 32)
    plan = cut_lineage(
        counts.withColumn("ahead", F.coalesce(ahead, F.lit(0))).join(goals, "source_key")
        .groupBy(F.col("bucket").alias("plan_bucket"))
        .agg(F.map_from_entries(F.collect_list(F.struct(
            "source_key", F.struct("ahead", "source_size", "target", rate.alias("rate"),
                                   offset.alias("offset"))))).alias("plan")))
    inside = Window.partitionBy("bucket", "source_key").orderBy("size", F.col("doc_id").asc_nulls_last())
    placed = (keyed.join(plan, F.col("bucket") == F.col("plan_bucket"))
              .select("doc_id", "source", "source_key", "size", "bucket", *keep,
                      F.element_at("plan", F.col("source_key")).alias("p"))
              .select("doc_id", "source", "source_key", "size", "bucket", *keep, "p.*")
              .withColumn("rank", F.row_number().over(inside)))
    upto = F.col("ahead") + F.col("rank")
    copies = (F.floor(F.col("offset") + F.col("rate") * upto)
              - F.floor(F.col("offset") + F.col("rate") * (upto - 1)))
    return placed.select("doc_id", "source", "size", "source_size", "target",
                         F.least(copies, F.lit(max_copies)).cast("int").alias("copies"), *keep)
