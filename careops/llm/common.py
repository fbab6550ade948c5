"""Helpers shared by the corpus operators.

A word is a run of characters other than U+0020 and U+0009-U+000D.  ASCII
white space is the same set that ``bytes.split()`` uses, so tasks split the
UTF-8 bytes of a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careops.session import cut_lineage, scratch_path

WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"

__all__ = ["WORD_RE", "SPACE_RE", "bounded_sample", "cut_lineage", "scratch_path", "read_table",
           "remainder", "chunks_by_size", "Words", "word_edges", "word_hashes", "window_hashes", "cover",
           "mix64", "release_memory"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the key's decimal text, modulo ``mod``; null for a null key."""
    return F.crc32(key.cast("string")) % F.lit(mod)


def bounded_sample(df: DataFrame, key: Column, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows, at most twice as many, chosen by a hash of ``key`` over the whole table.

    A table of at most ``rows`` rows is returned whole.
    """
    total = df.count()
    if total <= rows:
        return df
    cut = int(2 ** 53 * rows / total)
    return df.where(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(2 ** 53)) < F.lit(cut)).limit(2 * rows)


def chunks_by_size(values: Iterable, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) slices of a list of strings (or None), each of about ``size`` characters."""
    start, total, i = 0, 0, -1
    for i, v in enumerate(values):
        total += len(v) if v is not None else 0
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start <= i:
        yield start, i + 1


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in an array of UTF-8 bytes."""
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.greater(data - np.uint8(9), 4, out=inside[1:-1])  # not 9..13 (wraps below 9)
    inside[1:-1] &= data != 32
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


class Words:
    """The words of some texts (or None), as offsets into their joined UTF-8 bytes.

    ``starts``/``ends`` are the words' byte offsets; document i has the words
    ``first[i]`` to ``last[i]`` and the bytes ``base[i]`` to ``base[i] + size[i]``.
    """

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [t.encode() if t else b"" for t in texts]
        if lower:
            raw = [t.lower() for t in raw]  # A-Z only
        self.joined = b"\n".join(raw)
        self.data = np.frombuffer(self.joined, dtype=np.uint8)
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.base = np.cumsum(self.size + 1) - self.size - 1
        self.starts, self.ends = word_edges(self.data)
        self.first = np.searchsorted(self.starts, self.base)
        self.last = np.append(self.first[1:], len(self.starts)) if len(raw) else self.first
        self.n_words = self.last - self.first
        self.doc = np.repeat(np.arange(len(raw)), self.n_words)  # each word's document

    def windows(self, hashes: np.ndarray, window: int) -> np.ndarray:
        """First words of the windows that lie in one document (``hashes``: of all windows)."""
        if not len(hashes):
            return np.empty(0, np.int64)
        return np.flatnonzero(self.doc[:len(hashes)] == self.doc[window - 1:])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BASE = np.uint64(0x9E3779B97F4A7C15)     # odd: has an inverse modulo 2**64
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes (with its length), from prefix sums modulo 2**64."""
    out = np.empty(len(starts), dtype=np.uint64)
    inverse = np.uint64(pow(int(_BASE), -1, 2 ** 64))
    i = 0
    while i < len(starts):  # whole words in blocks, so that the temporary arrays stay small
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data[lo:hi]] * _powers(_BASE, hi - lo), out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * _powers(inverse, hi - lo + 1)[a] + (b - a).astype(np.uint64)
        i = j
    return mix64(out)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``window`` word hashes (modulo 2**64, then scrambled)."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(window):  # Horner's rule for all windows at once
        out *= _WORD_BASE
        out += words[k:k + n]
    return mix64(out)


def cover(at: np.ndarray, words: int, window: int) -> np.ndarray:
    """Mask of the words that lie in a window starting at one of ``at``."""
    steps = np.bincount(at, minlength=words + 1)[:words + 1] - np.bincount(at + window, minlength=words + 1)[:words + 1]
    return np.cumsum(steps)[:words] > 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and xor-shift, in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def release_memory() -> None:
    """Give back what earlier tasks of this Python worker have freed but the allocators still hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def byte_table(seed: int) -> np.ndarray:
    """256 fixed pseudo-random odd 64-bit values, one for each byte."""
    return np.random.default_rng(seed).integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = byte_table(20)
