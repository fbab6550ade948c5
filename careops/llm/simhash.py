"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is 64 bits.  Two fingerprints within ``bits`` differing bits,
cut into m = bits + 1 consecutive segments on a ring, must have a start from
which every chain of l segments differs in at most floor(l * bits / m) = l - 1
bits: its first segment is equal, its first two differ in at most one bit, and
so on around the ring.  The first two segments (32 bits for 3 bits) make the
join key: one side lists the key as it is, the other also with each bit of the
second segment flipped.  The longer chains filter inside the join, and the
chain over the whole ring is the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops.llm.common import cut_lineage, release_memory
from careops.llm.components import components

WIDTH = 64


def text_fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of one text as an unsigned 64-bit value; 0 for a text without a word."""
    words = text.encode().lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    if len(words) > shingle:
        pairs = zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
        hashes = [digest(line[a:b], 42) for a, b in pairs]
    else:
        hashes = [digest(line, 42)]
    counts = np.zeros(WIDTH, dtype=np.int64)
    values = np.array(hashes, dtype="<u8")
    for i in range(0, len(values), 16384):
        part = values[i:i + 16384]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, keep...): one row per input row; fp is the fingerprint as a signed long."""
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *keep)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for part in parts:
            fp = np.fromiter((text_fingerprint(t.as_py(), shingle) for t in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), *part.columns[2:]],
                                             names=["doc_id", "fp", *keep])

    return table.mapInArrow(run, T.StructType(T.StructType.fromDDL("doc_id long, fp long").fields
                                              + [table.schema[c] for c in keep]))


def _signed(x: int) -> int:
    x &= 2 ** WIDTH - 1
    return x - 2 ** WIDTH if x >= 2 ** (WIDTH - 1) else x


def _turned(x: Column, by: int) -> Column:
    """``x`` rotated right by ``by`` bits."""
    if by % WIDTH == 0:
        return x
    return F.shiftrightunsigned(x, by).bitwiseOR(F.shiftleft(x, WIDTH - by))


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct values in ``fps.fp`` with 1 to ``bits`` differing bits."""
    m = bits + 1
    edges = [WIDTH * i // m for i in range(m + 1)]
    widths = [edges[i + 1] - edges[i] for i in range(m)]
    # each row becomes dozens below: an explicit number of partitions is not coalesced by the size before that
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = fps.select("fp").where("fp is not null").repartition(n, "fp").distinct()
    if bits == 0:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a < b")
    exact, near = [], []
    for i in range(m):
        first, second = widths[i], widths[(i + 1) % m]
        key = _turned(F.col("fp"), edges[i]).bitwiseAND(F.lit(_signed(2 ** (first + second) - 1)))
        exact.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
        near += [F.struct(F.lit(i).alias("start"), key.bitwiseXOR(F.lit(_signed(flip))).alias("key"))
                 for flip in [0] + [1 << (first + p) for p in range(second)]]
    left = distinct.select(F.col("fp").alias("a"), F.explode(F.array(*near)).alias("k")).select("a", "k.*")
    right = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*exact)).alias("k")).select(
        "b", F.col("k.start").alias("start_b"), F.col("k.key").alias("key_b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(False)
    for i in range(m):
        fits = F.col("start") == i
        span = widths[i] + widths[(i + 1) % m]
        for n in range(3, m):
            span += widths[(i + n - 1) % m]
            part = _turned(diff, edges[i]).bitwiseAND(F.lit(_signed(2 ** span - 1)))
            fits = fits & (F.bit_count(part) <= n - 1)
        chain = chain | fits
    return (left.join(right, (left["start"] == right["start_b"]) & (left["key"] == right["key_b"])
                      & (F.col("a") < F.col("b")) & chain & (F.bit_count(diff) <= bits))
            .select("a", "b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Group documents whose fingerprints are linked, directly or through others, at ``bits`` or fewer bits.

    Returns one row per input row: ``doc_id``, ``fp`` (signed long),
    ``component_id``, the smallest doc_id reachable (itself included), and the
    ``keep`` columns.  Equal fingerprints are one node of the link graph, so copies cost no pairs.

    A null or wordless text has fingerprint zero and links like any other.
    Rows with a null id take part; a component whose ids are all null gets a
    null component_id.  Repeated rows each come out once.  An empty table
    gives an empty result; other columns of ``docs`` are not looked at.
    """
    fps = cut_lineage(fingerprints(docs, shingle, id_col, text_col, keep))
    classes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(classes, bits), "a", "b")
    rooted = cut_lineage(classes.join(roots, F.col("fp") == F.col("node"), "left")
                         .select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = cut_lineage(rooted.select("fp", "root").join(cut_lineage(least), "root")
                         .select(F.col("fp").alias("class_fp"), "component_id"))
    return fps.join(labels, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id", *keep)
