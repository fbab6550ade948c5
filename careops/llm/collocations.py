"""Phrase collocations from counting quotient filters.

Texts are cut into batches.  A batch's distinct words are counted in Spark;
the words that are frequent enough get ids, and a batch keeps the stretches of
frequent words as ids.  Then, for phrases of 2, 3, ... words, each batch puts
the phrases of its stretches into counting quotient filters
(:mod:`careops.llm.quotient_filter`), cut by the leading bits; the filters of
all batches for the same bits merge in order.  One bit for each phrase goes
back to its batch, which keeps the stretches whose phrases are all frequent:
every part of a frequent phrase is frequent, so nothing is lost.  Ids tell
words of different languages apart, so all languages are counted at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careops.llm import quotient_filter as qf
from careops.llm.common import chunks_by_size, cut_lineage, release_memory, scratch_path

BATCH_CHARS = 4_000_000
BUCKET_PHRASES = 1_000_000   # phrases that all batches together send to a bucket, about
WORDS_A_BUCKET = 100_000
RANK_SALT = 64

# 0: in a word, 1: between words, 2: between pieces
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2

_BATCH = "batch long, lang array<string>, word array<string>, n array<long>, ids binary"
_STATE = "batch long, seq binary, phrases long"
_MERGED = "ids array<array<long>>, n array<long>, marks array<struct<batch:long,bucket:int,marks:binary>>"


def _words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of some texts, each one's text, and whether a piece starts with it."""
    raw = [(t or "").encode().lower() for t in texts]  # bytes.lower() changes A-Z only
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = _KIND[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = kind == 0
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    breaks = np.cumsum(kind == 2)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    doc = np.searchsorted(np.cumsum(size), starts, side="right")
    fresh = np.ones(len(starts), bool)
    fresh[1:] = breaks[starts[1:]] > breaks[ends[:-1] - 1]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside[1:]])])
    return words, doc, fresh


def _tally(texts: list[str | None], langs: list[str]) -> tuple[list[str], list[str], np.ndarray, bytes] | None:
    """Distinct (lang, word) pairs, their counts, and the texts as places among the pairs (-1 between pieces)."""
    words, doc, fresh = _words_of(texts)
    if not len(words):
        return None
    coded = words.dictionary_encode()
    lang = pa.array(langs, pa.string()).dictionary_encode()
    n_langs = len(lang.dictionary)
    pair = coded.indices.to_numpy().astype(np.int64) * n_langs + lang.indices.to_numpy()[doc]
    pairs, which, counts = np.unique(pair, return_inverse=True, return_counts=True)
    ids = np.full(len(which) + int(fresh.sum()), -1, "<i4")
    ids[np.arange(len(which)) + np.cumsum(fresh)] = which
    return (lang.dictionary.take(pa.array(pairs % n_langs)).to_pylist(),
            coded.dictionary.take(pa.array(pairs // n_langs)).to_pylist(), counts, ids.tobytes())


def _stretches(ids: np.ndarray, good: np.ndarray, size: int, least: int) -> tuple[np.ndarray, int]:
    """The stretches of ``ids`` that are runs of ``least`` or more good phrases of ``size`` words, each behind a -1.

    ``good`` tells whether the phrase that starts at a place is good.  Also returned: how many phrases of one word more they have.
    """
    turns = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
    starts, runs = turns[::2], turns[1::2] - turns[::2]
    starts, runs = starts[runs >= least], runs[runs >= least]
    length = runs + size - 1
    ends = np.cumsum(length + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, -1, ids.dtype)
    first = ends - length
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(first, length) + at] = ids[np.repeat(starts, length) + at]
    return out, int((length - size).sum())


def _phrases(ids: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Places of the phrases of ``size`` words, their sorted distinct packed values, counts, and each place's value."""
    inside = np.cumsum(np.append(0, ids < 0))
    n = max(0, len(ids) - size + 1)
    at = np.flatnonzero(inside[size:size + n] == inside[:n])
    limbs = qf.pack(qf.permute([ids[at + j] for j in range(size)], bits), bits)
    return at, *qf.distinct(limbs)


def _bounds(limbs: list[np.ndarray], width: int, t: int) -> np.ndarray:
    """Where the values of each of 2**t buckets start, by the leading bits."""
    if not t:
        return np.array([0, len(limbs[0])])
    return np.append(np.searchsorted(limbs[0] >> np.uint64(min(64, width) - t), np.arange(2 ** t)), len(limbs[0]))


def _language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def _batches(docs: DataFrame, text_col: str, lang_col: str, batch_chars: int) -> DataFrame:
    spark = docs.sparkSession

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        n = TaskContext.get().partitionId() << 32
        for part in parts:
            texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lo, hi in chunks_by_size(texts, batch_chars):
                got = _tally(texts[lo:hi], langs[lo:hi])
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n]), pa.array([got[0]], pa.list_(pa.string())), pa.array([got[1]], pa.list_(pa.string())),
                         pa.array([got[2]], pa.list_(pa.int64())), pa.array([got[3]], pa.binary())],
                        names=["batch", "lang", "word", "n", "ids"])
                    n += 1

    path = scratch_path(spark, "words")
    docs.select(F.col(text_col).cast("string").alias("text"), _language(F.col(lang_col)).alias("lang")) \
        .mapInArrow(run, _BATCH).write.parquet(path)
    return spark.read.schema(_BATCH).parquet(path)


def _vocabulary(batches: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(lang, word, n, id) of the words that occur ``least`` times or more, and the bits of an id."""
    frequent = cut_lineage(batches.select(F.explode(F.arrays_zip("lang", "word", "n")).alias("w")).select("w.*")
                           .groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    n_buckets = max(1, -(-frequent.count() // WORDS_A_BUCKET))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word")) - 1
    placed = cut_lineage(frequent.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(n_buckets)))
                         .withColumn("place", place.cast("long")))
    most = placed.agg(F.max("place")).first()[0] or 0
    low = int(most).bit_length()
    bits = max(qf.MIN_BITS, low + (n_buckets - 1).bit_length())
    return placed.select("lang", "word", "n", (F.shiftleft("bucket", low) + F.col("place")).alias("id")), bits


def phrase_counts(docs: DataFrame, max_words: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang",
                  batch_chars: int = BATCH_CHARS, bucket_phrases: int = BUCKET_PHRASES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts of all phrases of up to ``max_words`` words that occur ``least`` times or more in their language.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line
    ends, and into words at blanks and tabs; phrases do not leave their piece,
    overlapping occurrences all count.  Returns three tables: ``totals`` (lang,
    n: all word occurrences), ``words`` (lang, word, n, id) and ``phrases``
    (ids: the word ids of the phrase, n; phrases of one word included).

    A null ``lang`` is ``und``; a null text has no word.  Repeated rows count
    as often as they come.  Empty tables give empty results; other columns are
    not looked at.
    """
    batches = _batches(docs, text_col, lang_col, batch_chars)
    totals = cut_lineage(batches.select(F.explode(F.arrays_zip("lang", "n")).alias("w"))
                         .groupBy("w.lang").agg(F.sum("w.n").alias("n")))
    words, bits = _vocabulary(batches, least)
    words = cut_lineage(words)
    dtype = "<i4" if bits < 32 else "<i8"

    def start(left: pa.Table, right: pa.Table) -> pa.Table:
        release_memory()
        local = np.frombuffer(left.column("ids")[0].as_py(), "<i4")
        known = np.full(int(local.max(initial=0)) + 2, -1, dtype)  # the last one stands for -1
        known[right.column("local").to_numpy()] = right.column("id").to_numpy()
        ids = known[local]
        seq, n = _stretches(ids, ids >= 0, 1, 2)
        return state_rows(left.column("batch")[0].as_py(), seq, n)

    def state_rows(batch: int, seq: np.ndarray, n: int) -> pa.Table:
        keep = 1 if n else 0
        return pa.table({"batch": pa.array([batch][:keep], pa.int64()), "seq": pa.array([seq.tobytes()][:keep], pa.binary()),
                         "phrases": pa.array([n][:keep], pa.int64())})

    local = (batches.select("batch", F.posexplode(F.arrays_zip("lang", "word")).alias("local", "w"))
             .select("batch", "local", "w.lang", "w.word")
             .join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("batch").alias("of"), "local", "id"))
    state = cut_lineage(batches.select("batch", "ids").groupBy("batch").cogroup(local.groupBy("of")).applyInArrow(start, _STATE))
    phrases = words.select(F.array("id").alias("ids"), "n")
    for size in range(2, max_words + 1):
        total = state.agg(F.sum("phrases")).first()[0] or 0
        if not total:
            break
        width = size * bits
        t = min((max(1, total // bucket_phrases) - 1).bit_length(), min(64, width) - 2 * qf.DIGIT_BITS)

        def shard(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release_memory()
            for part in parts:
                for batch, seq in zip(part.column(0).to_pylist(), part.column(1)):
                    _, limbs, counts, _ = _phrases(np.frombuffer(seq.as_buffer(), dtype), size, bits)
                    cut = _bounds(limbs, width, t)
                    full = np.flatnonzero(np.diff(cut)).tolist()
                    filters = [qf.to_bytes([x[cut[i]:cut[i + 1]] for x in limbs], counts[cut[i]:cut[i + 1]], width, t)
                               for i in full]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([batch] * len(full), pa.int64()),
                                                      pa.array(filters, pa.binary())], names=["bucket", "batch", "filter"])

        def join(table: pa.Table) -> pa.Table:
            table = table.sort_by("batch")
            parts = [qf.from_bytes(f.as_py()) for f in table.column("filter")]
            limbs, counts, place = qf.merge(parts)
            good = counts >= least
            ids = np.stack(qf.unpermute(qf.unpack([x[good] for x in limbs], size, bits), bits), axis=1).astype(np.int64)
            bucket, marks, pos = table.column("bucket")[0].as_py(), [], 0
            for batch, (_, own) in zip(table.column("batch").to_pylist(), parts):
                mine = good[place[pos:pos + len(own)]]
                pos += len(own)
                if mine.any():
                    marks.append({"batch": batch, "bucket": bucket, "marks": np.packbits(mine).tobytes()})
            mark_type = pa.struct([("batch", pa.int64()), ("bucket", pa.int32()), ("marks", pa.binary())])
            return pa.table({"ids": pa.array([ids.tolist()], pa.list_(pa.list_(pa.int64()))),
                             "n": pa.array([counts[good].tolist()], pa.list_(pa.int64())),
                             "marks": pa.array([marks], pa.list_(mark_type))})

        def narrow(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return state_rows(0, np.empty(0, dtype), 0)
            ids = np.frombuffer(left.column("seq")[0].as_py(), dtype)
            at, limbs, counts, place = _phrases(ids, size, bits)
            cut, good = _bounds(limbs, width, t), np.zeros(len(counts), bool)
            for bucket, marks in zip(right.column("bucket").to_pylist(), right.column("marks").to_pylist()):
                lo, hi = cut[bucket], cut[bucket + 1]
                good[lo:hi] = np.unpackbits(np.frombuffer(marks, np.uint8), count=hi - lo).astype(bool)
            here = np.zeros(len(ids), bool)
            here[at] = good[place]
            return state_rows(left.column("batch")[0].as_py(), *_stretches(ids, here, size, 2))

        merged = cut_lineage(state.select("batch", "seq").mapInArrow(shard, "bucket int, batch long, filter binary")
                             .groupBy("bucket").applyInArrow(join, _MERGED))
        found = merged.select(F.explode(F.arrays_zip("ids", "n")).alias("p")).select("p.ids", "p.n")
        phrases = phrases.unionByName(found)
        if size < max_words:
            marks = merged.select(F.explode("marks").alias("m")).select("m.*")
            state = cut_lineage(state.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(narrow, _STATE))
    return totals, words, phrases


def collocations(docs: DataFrame, max_words: int = 5, least: int = 100, top: int = 2000, cover_percent: int = 100,
                 text_col: str = "text", lang_col: str = "lang", batch_chars: int = BATCH_CHARS,
                 bucket_phrases: int = BUCKET_PHRASES) -> DataFrame:
    """The ``top`` collocations of each language.

    A candidate is a phrase of 2 to ``max_words`` words with a = f(phrase) >=
    ``least`` (counts as in :func:`phrase_counts`).  Cut after its first k
    words it scores floor(1000 * a * n / (l * r)), n the language's words, l
    and r the counts of both parts; the lowest score counts, ties to the
    smallest k.  Arithmetic is exact, in 38 decimal digits.  A candidate that lies
    in a longer one with at least ``cover_percent`` of its count is dropped.

    Returns ``lang``, ``rank`` (from 1; by score and a descending, then the
    phrase's bytes), ``phrase`` (words joined by a space), ``a``, ``l``, ``r``,
    ``n``, ``score``, ``words``.  Nulls, repeated rows and empty tables are as in
    :func:`phrase_counts`.
    """
    totals, words, counted = phrase_counts(docs, max_words, least, text_col, lang_col, batch_chars, bucket_phrases)
    counted = cut_lineage(counted)
    size = F.size("ids")
    candidates = counted.where(size > 1).withColumnRenamed("n", "a")
    # a longer candidate that covers this one has a part of one word more that does so too
    inner = F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids")
    longer = candidates.where(size > 2).select(inner, "a").groupBy("ids").agg(F.max("a").alias("a_longer"))
    kept = candidates.join(longer, "ids", "left").where(
        F.col("a_longer").isNull() | (100 * F.col("a_longer") < cover_percent * F.col("a"))).select("ids", "a")
    named = (kept.select("ids", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "lang", "word"), "id")
             .groupBy("ids").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
             .select("ids", "lang", F.col("w.word").alias("words")))
    left, right = (counted.select(F.col("ids").alias(f"{x}_ids"), F.col("n").alias(x)) for x in "lr")
    cuts = (kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
            .withColumn("l_ids", F.slice("ids", F.lit(1), F.col("k")))
            .withColumn("r_ids", F.slice("ids", F.col("k") + 1, size - F.col("k")))
            .join(left, "l_ids").join(right, "r_ids"))
    whole = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    scored = (cuts.join(named, "ids").join(totals, "lang")
              .withColumns({f"_{c}": x for c, x in whole.items()})
              .withColumn("score", F.expr("(CAST(1000 AS DECIMAL(4,0)) * (_a * _n)) div (_l * _r)"))
              .groupBy("ids").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"),
                                  F.first("n").alias("n"), F.first("lang").alias("lang"), F.first("words").alias("words"))
              .select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score", "words"))
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALT)))
    first = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
             .where(F.col("rank") <= top))
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words"))
