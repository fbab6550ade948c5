"""Exact top-k inner products by a three-phase uniform threshold.

A vector is cut into consecutive slices of components, and a score is the sum
of one partial score per slice: the lists of the threshold algorithm.  Vectors
and queries are dealt into blocks, and a task meets one block of each.

1. Every task sends, for each query and slice, its highest partial scores and
   the smallest one.  The vectors at the head of the gathered lists get their
   whole scores; the k-th best is a score that the k-th result can't be under.
2. With m slices, a vector whose partial scores all lie under their slice's
   smallest one plus an m-th of the distance from the sum of the smallest ones
   to that cutoff can't reach it.  The cutoff goes out with the queries, and
   each task keeps the vectors with a sufficient partial score, less those
   whose known partial scores plus the thresholds stay below the cutoff.
3. Their scores are resolved exactly, and the best k of each task are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careops.llm.common import cut_lineage

SLICES = 2
QUERY_BLOCK = 4096
VECTOR_BLOCK = 16384
STRIP = 256  # queries scored at once
EXACT = 2.0 ** 53


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros; as doubles if every sum of products is exact in them."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _numeric(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64), b.astype(np.float64)) if top < EXACT else (a, b)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id (``ids`` ascending)."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        pick = np.concatenate((above, level[:k - len(above)]))
    else:
        pick = np.arange(len(scores))
    return pick[np.lexsort((ids[pick], -scores[pick]))][:k]


def _strips(queries: np.ndarray, vectors: np.ndarray, slices: list[slice]):
    """(first query, one partial score matrix per slice) for strips of queries."""
    q, v = _numeric(queries, vectors)
    for lo in range(0, len(q), STRIP):
        yield lo, [np.rint(q[lo:lo + STRIP, s] @ v[:, s].T).astype(np.int64) for s in slices]


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): floor(scale * x) of each component; rows with a null id, a null vector or a null or non-finite component go."""
    x = F.col(vector_col).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & good)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("vec")))


def top_k(vectors: DataFrame, queries: Column, k: int = 10, slices: int = SLICES, query_block: int = QUERY_BLOCK,
          vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """The ``k`` highest inner products of each query with every row but its own.

    ``vectors`` has ``vec_id`` and ``vec`` (integers, see
    :func:`integer_vectors`); ``queries`` is a condition on them.  Returns
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: all rows if there
    are fewer than ``k``; ties go to the smaller ``vec_id``.

    Shorter vectors count as padded with zeros, empty ones score 0.  Rows that
    repeat an id and its vector are one row; different vectors under one id
    are rows of their own, of which none is compared with the same id, and the
    id's results are those of all its query vectors together.  Sums are 64-bit
    integers.  An empty table, or one without a query, gives no row.

    Every pair of a query block and a vector block is one group, of bounded
    size, so the work is spread however many queries there are; a task sends
    at most k rows per query and slice.
    """
    vectors = cut_lineage(vectors.select("vec_id", "vec").distinct())
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(queries.cast("long")).alias("q"),
                        F.max(F.size("vec")).alias("d")).first()
    n, n_queries, width = stats["n"], stats["q"] or 0, max(stats["d"] or 0, 1)
    q_blocks, v_blocks = max(1, -(-n_queries // query_block)), max(1, -(-n // vector_block))
    m = min(slices, width)
    edges = [width * i // m for i in range(m + 1)]
    parts = [slice(a, b) for a, b in zip(edges, edges[1:])]

    def spread(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64(rows.columns[0]), F.lit(blocks)).cast("int")
        return rows.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    asked = vectors.where(queries).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"))
    dealt = spread(vectors, "v_block", v_blocks, "q_block", q_blocks).groupBy("q_block", "v_block")

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("query_id"), right.sort_by("vec_id")
        q_ids, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        out: list[tuple] = []
        for lo, scores in _strips(_matrix(left.column("query"), width), _matrix(right.column("vec"), width), parts):
            whole = sum(scores) if scores else None
            for i in range(len(scores[0])):
                mine = np.flatnonzero(ids != q_ids[lo + i])
                for j, s in enumerate(scores):
                    row = s[i, mine]
                    for at in _best(row, ids[mine], k):
                        out.append((q_ids[lo + i], j, ids[mine[at]], row[at], whole[i, mine[at]], row.min()))
        names = ["query_id", "slice", "vec_id", "part", "score", "least"]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 6)], names=names)

    heads = cut_lineage(
        spread(asked, "q_block", q_blocks, "v_block", v_blocks).groupBy("q_block", "v_block").cogroup(dealt)
        .applyInArrow(gather, "query_id long, slice long, vec_id long, part long, score long, least long"))
    by_list = Window.partitionBy("query_id", "slice").orderBy(F.desc("part"), "vec_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    listed = (heads.withColumn("place", F.row_number().over(by_list)).where(F.col("place") <= k)
              .select("query_id", "vec_id", "score").distinct())
    cutoff = (listed.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k)
              .groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("found")))
    least = (heads.groupBy("query_id", "slice").agg(F.min("least").alias("least"))
             .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("slice", "least"))).alias("lists")))
    # fewer than k vectors in all lists: every vector is in them, and no cutoff holds
    bounds = cut_lineage(cutoff.join(least, "query_id").select(
        F.col("query_id").alias("b_id"), F.when(F.col("found") >= k, F.col("cutoff")).alias("cutoff"), F.col("lists.least").alias("least")))

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("query_id"), right.sort_by("vec_id")
        q_ids, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        cutoffs, floors = left.column("cutoff").to_pylist(), left.column("least").to_pylist()
        queries_m, vectors_m = _matrix(left.column("query"), width), _matrix(right.column("vec"), width)
        out: list[tuple] = []
        for lo, scores in _strips(queries_m, vectors_m, parts):
            for i in range(len(scores[0])):
                q = lo + i
                keep = ids != q_ids[q]
                if cutoffs[q] is not None:
                    share = (cutoffs[q] - sum(floors[q])) // m  # rounded down: the thresholds may not exceed the cutoff
                    limits = [f + share for f in floors[q]]
                    sent = np.stack([s[i] >= t for s, t in zip(scores, limits)])
                    most = sum(np.where(on, s[i], t) for on, s, t in zip(sent, scores, limits))
                    keep &= sent.any(axis=0) & (most >= cutoffs[q])
                left_over = np.flatnonzero(keep)
                exact = vectors_m[left_over] @ queries_m[q]
                for at in _best(exact, ids[left_over], k):
                    out.append((q_ids[q], ids[left_over[at]], exact[at]))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 3)],
                        names=["query_id", "vec_id", "score"])

    told = asked.join(bounds, F.col("query_id") == F.col("b_id")).select("query_id", "query", "cutoff", "least")
    found = (spread(told, "q_block", q_blocks, "v_block", v_blocks).groupBy("q_block", "v_block").cogroup(dealt)
             .applyInArrow(resolve, "query_id long, vec_id long, score long"))
    return (found.distinct().withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
