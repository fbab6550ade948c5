"""Token ids in compressed binary files.

Documents are sorted by id over the whole table.  A task tokenizes its range
of them segment by segment; a segment holds whole documents: a table of their
ids and lengths, and blocks of token ids coded by
:mod:`careops.llm.context_coder`, each by itself and with its checksum.
Segments are the records of Spark's text writer (which writes bytes as they
are), so files are written and committed by Spark, and read as binary files.

Layout of a segment, little-endian: magic, bytes that follow in front of the
checksum, partition, number in the partition, vocabulary, documents, blocks,
bytes of the packed document table; that table; for each block: ids,
dictionary size, bytes of the coded dictionary and of the coded places,
checksum of both; those bytes, block by block; checksum of all up to the
first block's bytes; a line end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careops.llm import context_coder
from careops.llm.common import Words, chunks_by_size, cut_lineage, release_memory

BLOCK = 4096
SEGMENT_CHARS = 8_000_000
FILE_SEGMENTS = 4
END_ID = 1
CACHE_WORDS = 800_000
# fixed value: what a segment starts with
MAGIC = b"TKSEG\x00\x00\x01"
_HEAD = struct.Struct("<8sQIIIIII")
_BLOCK = struct.Struct("<IIIII")
_CRC = struct.Struct("<I")

DOCUMENTS = "doc_id long, partition int, segment int, start_in_segment long, n_tokens long, ids_crc32 long, ids binary"


class SegmentError(ValueError):
    """A token file that is cut off or whose checksum does not fit."""


class WordEncoder:
    """Token ids of whole texts by a ``tokenizers`` file that cuts at every white space and drops it.

    Then a text's ids are its words' ids one after another, so each distinct
    word is encoded once.  At most CACHE_WORDS words are kept.  Any other
    tokenizer encodes text by text.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            kind = json.load(f)
        # fixed value: a pattern that keeps letters, digits one by one and other signs, but no white space
        words = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        steps = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or []
        cuts = [s for s in steps if s["type"] == "Split" and s.get("invert") and s["behavior"] == "Removed"]
        self.by_word = any(s["pattern"].get("Regex", "").endswith(words) for s in cuts)
        self.vocab = max(self.tokenizer.get_vocab_size(with_added_tokens=True), END_ID + 1)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _add(self, words: list[str]) -> None:
        got = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        size = np.bincount(np.array(got.word_ids, np.int64), minlength=len(words)) if got.ids else np.zeros(len(words), np.int64)
        for w in words:
            self.place[w] = len(self.place)
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, np.array(got.ids, "<u4"))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the number of ids of each."""
        if not self.by_word:
            ids = [np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, END_ID], "<u4") for t in texts]
            return np.concatenate(ids) if ids else self.flat[:0], np.fromiter(map(len, ids), np.int64, len(ids))
        w = Words(texts)
        inside = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(inside, w.starts, 1)
        np.subtract.at(inside, w.ends, 1)
        offsets = np.concatenate(([0], np.cumsum(w.ends - w.starts))).astype(np.int32)
        letters = w.data[np.cumsum(inside)[:-1] > 0]
        words = pa.Array.from_buffers(pa.string(), len(w.starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        if len(self.place) + len(known) > CACHE_WORDS:
            self._clear()
        new = [x for x in known if x not in self.place]
        if new:
            self._add(new)
        place = np.fromiter((self.place[x] for x in known), np.int64, len(known))[coded.indices.to_numpy()]
        # every text's words, then the end
        at = np.arange(len(place)) + w.doc
        start, size = (np.zeros(len(place) + len(texts), np.int64) for _ in range(2))
        size[:] = 1
        start[:] = len(self.flat)
        start[at], size[at] = self.start[place], self.size[place]
        ends = np.cumsum(size)
        source = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        ids = np.append(self.flat, np.uint32(END_ID))[source]
        return ids, np.diff(np.append(0, ends[w.last + np.arange(len(texts))]))


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file, read once."""
    if path not in _encoders:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, vocab: int, partition: int = 0,
                  number: int = 0, block: int = BLOCK) -> bytes:
    """One segment of whole documents with ``sizes`` ids each."""
    blocks = [ids[i:i + block] for i in range(0, len(ids), block)]
    coded = context_coder.encode(blocks, vocab) if blocks else []
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    table = zlib.compress(known.tobytes() + numbers.tobytes() + sizes.astype("<u4").tobytes(), 6)
    heads = b"".join(_BLOCK.pack(len(b), n, len(d), len(p), zlib.crc32(p, zlib.crc32(d)))
                     for b, (n, d, p) in zip(blocks, coded))
    body = b"".join(d + p for _, d, p in coded)
    rest = len(table) + len(heads) + len(body)
    head = _HEAD.pack(MAGIC, rest, partition, number, vocab, len(doc_ids), len(blocks), len(table)) + table + heads
    return head + body + _CRC.pack(zlib.crc32(head))


def read_segments(data: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(partition, number, document ids, sizes, token ids) of the segments of a file."""
    pos = 0
    while pos < len(data):
        if len(data) < pos + _HEAD.size:
            raise SegmentError("a segment is cut off")
        magic, rest, partition, number, vocab, n_docs, n_blocks, n_table = _HEAD.unpack_from(data, pos)
        end = pos + _HEAD.size + rest
        if magic != MAGIC or len(data) < end + _CRC.size or n_table + n_blocks * _BLOCK.size > rest:
            raise SegmentError("no segment, or one that is cut off")
        at = pos + _HEAD.size + n_table + n_blocks * _BLOCK.size
        if zlib.crc32(data[pos:at]) != _CRC.unpack_from(data, end)[0]:
            raise SegmentError("checksum of a segment's tables")
        table = zlib.decompress(data[pos + _HEAD.size:pos + _HEAD.size + n_table])
        known = np.frombuffer(table, np.uint8, n_docs)
        numbers = np.frombuffer(table, "<i8", n_docs, n_docs).tolist()
        sizes = np.frombuffer(table, "<u4", n_docs, 9 * n_docs).astype(np.int64)
        coded = []
        for i in range(n_blocks):
            n, words, d, p, crc = _BLOCK.unpack_from(data, pos + _HEAD.size + n_table + i * _BLOCK.size)
            parts = data[at:at + d], data[at + d:at + d + p]
            if zlib.crc32(parts[1], zlib.crc32(parts[0])) != crc:
                raise SegmentError(f"checksum of block {i}")
            coded.append((n, words, *parts))
            at += d + p
        ids = np.concatenate(context_coder.decode(coded, vocab)) if coded else np.zeros(0, np.int64)
        yield partition, number, [x if k else None for x, k in zip(numbers, known)], sizes, ids.astype("<u4")
        pos = end + _CRC.size + 1  # the writer's line end


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 block: int = BLOCK, segment_chars: int = SEGMENT_CHARS, file_segments: int = FILE_SEGMENTS) -> None:
    """Write the token ids of all documents, each with id 1 at its end, in ascending order of ``doc_id``.

    A null or empty text is one token, the end.  Rows with equal ids are
    ordered by a hash of their text, so that a range of them can be split; null ids come
    last.  An empty table writes no segment.  Other columns of ``docs`` are not
    looked at.  A file holds at most ``file_segments`` segments of about
    ``segment_chars`` characters, more only where one text is longer.
    """
    spark = docs.sparkSession
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = (F.col("doc_id").asc_nulls_last(), F.col("hash"))
    chars = table.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (file_segments * segment_chars)))
    ordered = (table.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, *order)
               .sortWithinPartitions(*order).select("doc_id", "text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encode, number = word_encoder(tokenizer_path), 0
        partition = TaskContext.get().partitionId()
        held_ids: list = []
        held_texts: list[str] = []
        held = 0

        def segment() -> pa.RecordBatch:
            nonlocal number, held
            ids, sizes = encode(held_texts)
            data = write_segment(held_ids, sizes, ids, encode.vocab, partition, number, block)
            number, held = number + 1, 0
            held_ids.clear()
            held_texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for part in parts:
            texts = part.column(1).to_pylist()
            for lo, hi in chunks_by_size(texts, segment_chars // 8):
                held_ids += part.column(0).slice(lo, hi - lo).to_pylist()
                held_texts += texts[lo:hi]
                held += sum(map(len, texts[lo:hi]))
                if held >= segment_chars:
                    yield segment()
        if held_ids:
            yield segment()

    (ordered.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", file_segments).text(path))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of token files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` (of its little-endian 32-bit ids), ``ids`` (those; null unless ``with_ids``).

    Raises :class:`SegmentError` in the task if a file is damaged.  A folder without segments gives no row.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("partition", pa.int32()), ("segment", pa.int32()),
                        ("start_in_segment", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for part in parts:
            for data in part.column(0):
                for partition, number, docs, sizes, ids in read_segments(data.as_py()):
                    ends = np.cumsum(sizes)
                    raw, pieces = ids.tobytes(), list(zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array([partition] * len(docs), pa.int32()),
                         pa.array([number] * len(docs), pa.int32()), pa.array(ends - sizes), pa.array(sizes),
                         pa.array([zlib.crc32(raw[a:b]) for a, b in pieces], pa.int64()),
                         pa.array([raw[a:b] if with_ids else None for a, b in pieces], pa.binary())], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return with_starts(files.mapInArrow(run, DOCUMENTS))


def with_starts(documents: DataFrame) -> DataFrame:
    """Starts over all files, from the sums of segments and partitions."""
    documents = cut_lineage(documents)
    segments = documents.groupBy("partition", "segment").agg(F.sum("n_tokens").alias("n"))
    partitions = segments.groupBy("partition").agg(F.sum("n").alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    whole = Window.orderBy("partition").rowsBetween(*earlier)  # one row for each partition
    first = partitions.select("partition", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("first"))
    inner = Window.partitionBy("partition").orderBy("segment").rowsBetween(*earlier)
    base = (segments.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(first, "partition")
            .select("partition", "segment", (F.col("first") + F.col("inner")).alias("base")))
    return (documents.join(base, ["partition", "segment"])
            .select("doc_id", (F.col("base") + F.col("start_in_segment")).alias("start"), "n_tokens", "ids_crc32", "ids"))
