"""Connected components of a link table, by alternating star contraction.

Each round rewires every node's larger neighbours to the smallest node it
knows (large star), then its smaller neighbours likewise (small star), until
no link changes; every node then points straight at its component's smallest
node.  The number of rounds grows with the logarithm of the longest chain.
A hub's links are reduced by a map-side combined ``min`` and met again in a
join whose two sides are checkpoints, so that adaptive execution can split a
hub's share of rows.  Nothing but two counters per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careops.llm.common import cut_lineage

MAX_ROUNDS = 60


def _to_smallest(links: DataFrame) -> DataFrame:
    """For links (u, v): each u with the smallest of itself and its v's, joined to the links again."""
    least = cut_lineage(links.groupBy("u").agg(F.min("v").alias("m"))
                        .select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
    return links.join(least, links["u"] == least["w"]).select("u", "v", "m")


def _mark(links: DataFrame) -> tuple[int, int]:
    # xxhash64 summed in decimal: order-free, and exact at any row count
    row = links.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the component's smallest node; only nodes with a link other than to themselves.

    ``a`` and ``b`` are long columns.  Null ends and self links are ignored;
    an empty table gives an empty result.
    """
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .where("u > v").distinct())
    before = _mark(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MAX_ROUNDS):
        both = cut_lineage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = cut_lineage(_to_smallest(both).where("v > u")
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _to_smallest(large)
        edges = cut_lineage(
            small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u > v").distinct())
        now = _mark(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
