"""Sum-of-squares online packing of token sequences.

Each task packs the documents of its partition as they come.  A document's
full windows are sequences of their own; what is left is placed, whole, into
the open sequence whose new fill level makes the sum of squared counts of
partly filled sequences smallest (Csirik and others' sum-of-squares rule), or
opens one.  A level array holds the counts.  At the end, or when too many
sequences are open, the emptiest open sequences are cut up to fill the fullest
ones; what remains over is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careops.llm.common import Words, chunks_by_size, mix64, release_memory, word_hashes

CAPACITY = 2048
MAX_OPEN = 4096
END_ID = 1
CACHE_ENTRIES = 800_000
GROUP_CHARS = 2_000_000

_SPACES = re.compile(r"\s\s")
# fixed value: the pattern that byte-level BPE cuts texts by
_W = r"\p{White_Space}"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|{_W}+(?!\P{{White_Space}})|{_W}+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable ones as they are, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts by a ``tokenizers`` file, the same as its own ``encode`` gives.

    Byte-level BPE cuts a text into pieces by a pattern and never joins across
    them, and the pattern always cuts in front of a white-space character that
    stands alone.  So a text without white space in a row is cut there; the
    distinct words of a group of texts, told apart by 64-bit hashes of their
    bytes with the character in front, are encoded once by the tokenizer's
    model and the texts put together from them.  Up to CACHE_ENTRIES words are
    kept, as sorted hashes with places in one array of ids.  Other texts, and
    those with a special token's string, take the tokenizer's own way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path) as f:
            kind = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        cut = kind.get("pre_tokenizer") or {}
        self.plain = not (cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
                          and not kind.get("normalizer") and kind["model"].get("type", "BPE") == "BPE")
        self.special = [t["content"] for t in kind.get("added_tokens") or []]
        self.letters = _byte_letters()
        self._clear()

    def _clear(self):
        self.keys = np.empty(0, np.uint64)  # sorted hashes of the known words
        self.start = np.empty(0, np.int64)  # of each one's ids in ``flat``
        self.size = np.empty(0, np.int64)
        self.flat = np.empty(0, "<u4")

    def _word(self, word: bytes) -> bytes:
        pieces = _PIECES.findall(word.decode())
        letters = [p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        return array("I", [t.id for p in letters for t in self.tokenizer.model.tokenize(p)]).tobytes()

    def _own(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        regular = [bool(t) and not (self.plain or t[-1].isspace() or _SPACES.search(t) or any(s in t for s in self.special))
                   for t in texts]
        out = [None if r else self._own(t) for r, t in zip(regular, texts)]
        places = [i for i, r in enumerate(regular) if r]
        if not places:
            return out
        w = Words([texts[i] for i in places])
        lead = w.data[w.starts - 1].astype(np.uint64)
        lead[w.starts == w.base[w.doc]] = 0  # a text's first word, with nothing in front
        keys = mix64(word_hashes(w.data, w.starts, w.ends) + lead)
        keys, at, which = np.unique(keys, return_index=True, return_inverse=True)
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys
        if len(self.keys) + len(keys) - known.sum() > CACHE_ENTRIES:
            self._clear()
            known[:] = False
        new = np.flatnonzero(~known)
        if len(new):
            raw = [self._word(w.joined[w.starts[i] - (lead[i] > 0):w.ends[i]]) for i in at[new]]
            size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            place = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, place, keys[new])
            self.start = np.insert(self.start, place, len(self.flat) + np.cumsum(size) - size)
            self.size = np.insert(self.size, place, size)
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(raw), dtype="<u4")))
        found = np.searchsorted(self.keys, keys)
        starts, sizes = self.start[found], self.size[found]
        n = sizes[which]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1])]
        for i, piece in zip(places, np.split(ids, ends[w.last[:-1] - 1])):
            out[i] = piece
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, read once."""
    if path not in _encoders:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Open sequences by fill level; yields pieces (document, start, ids, sequence, offset) as sequences close."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.counts = np.zeros(capacity + 1, dtype=np.int64)  # N(h); 0 and capacity stay 0
        self.open: list[list[list]] = [[] for _ in range(capacity)]  # by level: lists of pieces
        self.n_open = self.n_closed = 0

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids in pieces:
            yield doc, start, ids, self.n_closed, offset
            offset += len(ids)
        self.n_closed += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.capacity * self.capacity
        for i in range(0, whole, self.capacity):
            yield from self._close([(doc, i, ids[i:i + self.capacity])])
        size = len(ids) - whole
        if not size:
            return
        # N(h)**2 changes by 1 - 2 N(h) where a sequence leaves a level and 1 + 2 N(h) where one arrives
        n = self.counts
        change = 2 * (n[size:] - n[:self.capacity - size + 1]) + 2  # from level h to h + size
        change[-1] = 1 - 2 * n[self.capacity - size]                # a full one counts no more
        change[n[:self.capacity - size + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 1 + 2 * n[size]                                 # a new one
        level = len(change) - 1 - int(np.argmin(change[::-1]))      # ties: the fullest
        pieces = self.open[level].pop() if level else []
        if level:
            n[level] -= 1
            self.n_open -= 1
        pieces.append((doc, whole, ids[whole:]))
        if level + size == self.capacity:
            yield from self._close(pieces)
            return
        self.open[level + size].append(pieces)
        n[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        """Close all open sequences: fill the fullest with cuts of the emptiest, then split the last into powers of two."""
        rest = [p for level in self.open for p in level]  # emptiest first
        self.open = [[] for _ in range(self.capacity)]
        self.counts[:] = 0
        self.n_open = 0
        spare: list = []  # pieces of the emptiest sequences, to fill with
        lo, hi = 0, len(rest) - 1
        while lo <= hi:
            pieces = rest[hi]
            hi -= 1
            room = self.capacity - sum(len(p[2]) for p in pieces)
            while room and (spare or lo <= hi):
                if not spare:
                    spare = rest[lo][::-1]
                    lo += 1
                doc, start, ids = spare.pop()
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:]))
                    ids = ids[:room]
                pieces.append((doc, start, ids))
                room -= len(ids)
            if not room:
                yield from self._close(pieces)
            else:
                spare = pieces[::-1] + spare
                break
        left = sum(len(p[2]) for p in spare)
        while left:
            room = 1 << (min(left, self.capacity).bit_length() - 1)
            left -= room
            pieces = []
            while room:
                doc, start, ids = spare.pop()
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:]))
                    ids = ids[:room]
                pieces.append((doc, start, ids))
                room -= len(ids)
            yield from self._close(pieces)


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = True, max_open: int = MAX_OPEN) -> DataFrame:
    """Pack the token ids of all documents into sequences of at most ``capacity`` (a power of two) ids.

    A document's ids are its text's, then id 1 once.  Returns one row per
    piece: ``doc_id``, ``start`` (the document's ids before it), ``length``,
    ``ids_crc32`` (of its little-endian 32-bit ids), ``doc_tokens``,
    ``sequence_id``, ``offset`` in the sequence and ``ids`` (those 32-bit
    ids; null unless ``with_ids``).  Every id lies in exactly one piece.  A
    sequence is full or holds a power of two of ids, so none needs padding; at
    most about log2(capacity) sequences per partition or flush aren't full.

    Partitions are packed by themselves, without a shuffle, and a sequence's
    number leads with its partition's.  A task holds at most ``max_open``
    open sequences; one more and they are filled and closed as at the end.

    A null or empty text is one token, the end.  Documents with a null id, and
    repeated rows, are packed like any others.  An empty table gives no piece;
    other columns of ``docs`` are not looked at.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                        ("offset", pa.int64()), ("ids", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encode, packer = encoder(tokenizer_path), Packer(capacity, max_open)
        first = TaskContext.get().partitionId() << 40
        rows: list = []

        def take(pieces):
            for (doc, total), start, ids, seq, offset in pieces:
                raw = ids.tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), total, first + seq, offset,
                             raw if with_ids else None))

        def batch() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(schema)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            rows.clear()
            return out

        end = np.array([END_ID], dtype="<u4")
        for part in parts:
            docs, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            for lo, hi in chunks_by_size(texts, GROUP_CHARS):
                for doc, ids in zip(docs[lo:hi], encode(texts[lo:hi])):
                    ids = np.concatenate((ids, end))
                    take(packer.add((doc, len(ids)), ids))
                    if len(rows) >= 2000:
                        yield batch()
        take(packer.flush())
        yield batch()

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, PIECES))
