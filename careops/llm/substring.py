"""Removal of repeated token windows (substring dedup) by Rabin-Karp hashes counted in Spark.

Documents are dealt into batches that are consecutive ranges of doc_id.  A
task hashes every window of its batch and sends the distinct hashes, cut into
buckets by their leading bits, as packed arrays; so a passage that fills the
corpus costs one hash per batch.  Each bucket is counted as a sorted array:
a hash that an earlier batch also has is marked, and the marks go back as one
bit per hash.  The batch then removes the windows that are marked, or that a
smaller document of the same batch has.  Because batches are in doc_id order,
no document ids have to be shuffled with the hashes.  Documents without an id
are dealt by a hash of their text into batches of their own, behind the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops.llm.common import Words, cover, release_memory, window_hashes, word_hashes

BATCH_CHARS = 8_000_000
BUCKET_WINDOWS = 4_000_000
CUT_CHARS = 4_000   # a document counts once for so many characters where batches are cut


class _Batch:
    """The texts of one batch in doc_id order (nulls last) with their words and window hashes."""

    def __init__(self, table: pa.Table, window: int):
        # documents as ranks of their ids: equal ids are one document, null ids come last
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_end")
        table = table.take(order)
        self.table = table
        ranks = pc.rank(table.column("doc_id"), "ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
        self.texts = table.column("text").to_pylist()
        self.words = w = Words(self.texts)
        hashes = window_hashes(word_hashes(w.data, w.starts, w.ends), window)
        self.at = w.windows(hashes, window)                       # first word of each window
        doc = w.doc[self.at]
        self.values, self.which = np.unique(hashes[self.at], return_inverse=True)
        rank = ranks[doc]
        least = np.full(len(self.values), np.iinfo(np.int64).max)
        np.minimum.at(least, self.which, rank)
        self.later = rank > least[self.which]                     # a smaller document here has the window


def _buckets(values: np.ndarray, n: int) -> np.ndarray:
    """Bounds of ``n`` equal ranges of the 64-bit space in a sorted array of hashes."""
    cuts = np.array([i * 2 ** 64 // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(values, cuts), [len(values)]))


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of True."""
    turns = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                   batch_chars: int = BATCH_CHARS, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Remove each word covered by a ``window``-word window that also starts in a document with a smaller id.

    Returns one row per input row: ``doc_id``, ``n_words``, ``n_removed``,
    ``spans`` (maximal removal intervals as [start, end) word positions),
    ``text`` (the input text if nothing is removed, else the kept stretches
    with their own white space inside, joined by one space) and the ``keep``
    columns.

    Windows are judged on the input and never cross documents.  A null text
    has no words and stays null.  Rows with equal ids are one document: they
    don't remove each other's words.  Null ids come after all others and don't
    remove each other's words.  An empty table gives an empty result; other
    columns of ``docs`` are not looked at.

    Equality of windows is equality of 64-bit hashes: among n different
    windows about n * n / 2**65 pairs are taken for equal by chance.
    """
    spark = docs.sparkSession
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    length = F.coalesce(F.length("text"), F.lit(0))
    row = table.agg(F.sum(length).alias("chars"), F.count("doc_id").alias("n"),
                    F.sum(F.when(F.col("doc_id").isNull(), length)).alias("null_chars")).first()
    chars, null_chars = row["chars"] or 0, row["null_chars"] or 0
    n_batches = max(1, -(-(chars - null_chars) // batch_chars))
    n_null = -(-null_chars // batch_chars) or 1
    n_buckets = max(1, -(-chars // (4 * bucket_windows)))  # a word has about four characters or more
    cuts: list[int] = []
    if n_batches > 1 and row["n"]:
        shares = [i / n_batches for i in range(1, n_batches)]
        by_length = table.select("doc_id", F.explode(F.array_repeat(F.lit(0), (1 + length / CUT_CHARS).cast("int"))))
        cuts = sorted(set(by_length.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n_batches))).first()[0]))
    bounds = np.array(cuts, dtype=np.int64)  # 8 bytes for each batch_chars of text
    first_null = len(cuts) + 1  # the batches from here on hold the documents without an id

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"))

    behind = (F.lit(first_null) + F.pmod(F.xxhash64("text"), F.lit(n_null))).cast("int")
    known = place(F.coalesce("doc_id", F.lit(0).cast("long"))) if cuts else F.lit(0)
    dealt = table.withColumn("batch", F.when(F.col("doc_id").isNull(), behind).otherwise(known))

    def hashes(table: pa.Table) -> pa.Table:
        release_memory()
        values = _Batch(table, window).values
        cut = _buckets(values, n_buckets)
        full = np.flatnonzero(np.diff(cut))
        return pa.table({"bucket": pa.array(full, pa.int32()),
                         "batch": pa.array([table.column("batch")[0].as_py()] * len(full), pa.int32()),
                         "hashes": pa.array([values[cut[i]:cut[i + 1]].tobytes() for i in full], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        packed = table.column("hashes").to_pylist()
        values = np.frombuffer(b"".join(packed), dtype=np.uint64)
        # null ids are equal, so their batches don't mark each other's hashes
        rank = np.minimum(np.array(table.column("batch").to_pylist()), first_null)
        rank = np.repeat(rank, [len(p) // 8 for p in packed])
        order = np.argsort(values, kind="stable")  # within a hash: earliest batch first
        ordered = values[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        seen = np.zeros(len(values), dtype=bool)
        seen[order] = rank[order] > np.repeat(rank[order[first]], np.diff(np.append(first, len(values))))
        parts = np.split(seen, np.cumsum([len(p) // 8 for p in packed])[:-1])
        marked = pa.array([i for i, p in enumerate(parts) if p.any()], pa.int64())
        return pa.table({"batch": table.column("batch").take(marked).cast(pa.int32()),
                         "bucket": table.column("bucket").take(marked).cast(pa.int32()),
                         "marks": pa.array([np.packbits(parts[i]).tobytes() for i in marked.to_pylist()], pa.binary())})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Batch(left, window)
        cut = _buckets(b.values, n_buckets)
        earlier = np.zeros(len(b.values), dtype=bool)
        for bucket, marks in zip(right.column("bucket").to_pylist(), right.column("marks").to_pylist()):
            lo, hi = cut[bucket], cut[bucket + 1]
            earlier[lo:hi] = np.unpackbits(np.frombuffer(marks, np.uint8), count=hi - lo).astype(bool)
        w = b.words
        gone = cover(b.at[b.later | earlier[b.which]], len(w.starts), window)
        spans, texts = [], []
        for i, (lo, hi) in enumerate(zip(w.first.tolist(), w.last.tolist())):
            mask = gone[lo:hi]
            runs = _runs(mask) if mask.any() else []
            spans.append([{"start": s, "end": e} for s, e in runs])
            if not runs:
                texts.append(b.texts[i])
                continue
            kept = [w.joined[w.starts[lo + s]:w.ends[lo + e - 1]] for s, e in _runs(~mask)]
            texts.append(b" ".join(kept).decode())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": b.table.column("doc_id"), "n_words": pa.array(w.n_words, pa.int64()),
                         "n_removed": pa.array([sum(s["end"] - s["start"] for s in x) for x in spans], pa.int64()),
                         "spans": pa.array(spans, span), "text": pa.array(texts, pa.string()),
                         **{c: b.table.column(c) for c in keep}})

    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, "
                                  "spans array<struct<start:int,end:int>>, text string")
    n = max(first_null + n_null, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_batch = dealt.repartition(n, "batch")
    marks = (by_batch.groupBy("batch").applyInArrow(hashes, "bucket int, batch int, hashes binary")
             .groupBy("bucket").applyInArrow(count, "batch int, bucket int, marks binary"))
    return (by_batch.groupBy("batch").cogroup(marks.groupBy("batch"))
            .applyInArrow(remove, T.StructType(schema.fields + [table.schema[c] for c in keep])))
