"""Quality rules as a short-circuit cascade.

Each rule says of one text whether it is bad.  On a sample every rule runs on
every text: that gives the seconds a rule takes and which texts it rejects.
The rules are then put in order, each time the one with most rejections, among
the texts that the earlier ones let pass, per second.  Over the whole table a
text meets the rules in that order, up to the first that rejects it.  The
order changes the work, not the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops.llm.common import Words, bounded_sample, chunks_by_size, cover, window_hashes, word_hashes

SAMPLE_ROWS = 1000
GROUP_CHARS = 2_000_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_UPPER = bytes(range(65, 91))
_ASCII_LETTERS = _UPPER + bytes(range(97, 123))


@dataclass
class Text:
    """What the rules see of a text: its UTF-8 bytes and the base counts."""

    raw: bytes
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def many_symbols(t: Text) -> bool:
    """More than one symbol to ten words."""
    return 10 * t.n_symbols > t.n_words


def odd_word_length(t: Text) -> bool:
    """A mean word length outside 2 to 15 characters (whole words of 15 occur in compounding languages)."""
    return not 2 * t.n_words <= t.word_chars <= 15 * t.n_words


def repeated_lines(t: Text) -> bool:
    """More than 30 % of the lines repeat an earlier one."""
    return 10 * t.n_dup_lines > 3 * (t.raw.count(b"\n") + 1)


def mostly_capitals(t: Text) -> bool:
    """More than half of the A-Z and a-z letters are capitals."""
    return 2 * _count(t.raw, _UPPER) > _count(t.raw, _ASCII_LETTERS)


def few_letters(t: Text) -> bool:
    """Less than half of the characters of words are letters; bytes beyond ASCII count as letters."""
    other = len(t.raw.translate(None, _ASCII_LETTERS + bytes(range(128, 256)) + b" \t\n\r\x0b\x0c"))
    return 2 * other > t.word_chars


def few_distinct_words(t: Text) -> bool:
    """Less than one distinct word in twenty; a text of many words draws on a growing vocabulary."""
    return 20 * len(set(t.raw.split())) < t.n_words


Rule = Callable[[Text], bool]
RULES: tuple[Rule, ...] = (few_distinct_words, few_letters, many_symbols, mostly_capitals, odd_word_length,
                           repeated_lines)


def base_counts(texts: list[str | None]) -> tuple[Words, dict[str, np.ndarray]]:
    """The base counts of some texts."""
    w = Words(texts)
    n = len(texts)
    spread = np.append(w.first, len(w.starts))
    in_word = np.concatenate(([0], np.cumsum(w.ends - w.starts)))
    bytes_in_words = np.diff(in_word[spread])
    # code points: bytes in words other than UTF-8 continuation bytes, which lie in words only
    later = np.concatenate(([0], np.cumsum((w.data & 0xC0) == 0x80)))
    edges = np.append(w.base, len(w.data) + 1)
    word_chars = bytes_in_words - (later[np.minimum(edges[1:], len(w.data))] - later[edges[:-1]])
    symbols = np.array([_count(w.joined[b:b + s], SYMBOLS) for b, s in zip(w.base.tolist(), w.size.tolist())], np.int64)
    dup_lines = np.zeros(n, np.int64)
    for i, (b, s) in enumerate(zip(w.base.tolist(), w.size.tolist())):
        lines = [x for x in w.joined[b:b + s].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        dup_lines[i] = len(lines) - len(set(lines))
    hashes = window_hashes(word_hashes(w.data, w.starts, w.ends), WINDOW)
    at = w.windows(hashes, WINDOW)
    # a window's hash together with its document's number
    key = hashes[at] ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, which, often = np.unique(key, return_inverse=True, return_counts=True)
    twice = cover(at[often[which] > 1] if len(at) else at, len(w.starts), WINDOW)
    repeats = np.bincount(w.doc[twice], minlength=n)
    return w, {"n_words": w.n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
               "n_repeat_words": repeats}


def _texts(texts: list[str | None]) -> Iterator[tuple[int, dict, np.ndarray, Callable[[int], Text]]]:
    """Groups of texts: (first row, base counts, base_failed, the Text of a row of the group)."""
    for lo, hi in chunks_by_size(texts, GROUP_CHARS):
        w, c = base_counts(texts[lo:hi])
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        yield lo, c, failed, lambda i, w=w, c=c: Text(
            w.joined[w.base[i]:w.base[i] + w.size[i]], **{k: int(v[i]) for k, v in c.items()})


@dataclass
class Estimate:
    """A rule's place in the order, with the figures that gave it."""

    rule: Rule
    seconds: float     # on the sample
    rejected: int      # of the sample's texts that reached it


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
                id_col: str = "doc_id", text_col: str = "text") -> list[Estimate]:
    """Order the rules by rejections per second, measured on about ``sample_rows`` rows (at most twice as many).

    Only counts by set of rejecting rules and summed seconds reach the driver.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets, spent = [], np.zeros(len(rules))
            for _, c, failed, text in _texts(part.column(0).to_pylist()):
                for i in np.flatnonzero(~failed):
                    t, found = text(i), 0
                    for k, rule in enumerate(rules):
                        began = time.perf_counter()
                        found |= bool(rule(t)) << k
                        spent[k] += time.perf_counter() - began
                    sets.append(found)
            values, counts = np.unique(np.array(sets, np.int64), return_counts=True)
            rows = [(int(v), int(n), None) for v, n in zip(values, counts)] + [(-1 - k, 0, s) for k, s in enumerate(spent)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (
                pa.int64(), pa.int64(), pa.float64()))], names=["found", "n", "seconds"])

    sample = bounded_sample(docs, F.col(id_col), sample_rows, "quality").select(F.col(text_col).cast("string"))
    got = (sample.mapInArrow(run, "found long, n long, seconds double")
           .groupBy("found").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds")).collect())
    seconds = {-1 - r["found"]: r["seconds"] for r in got if r["found"] < 0}
    sets = {r["found"]: r["n"] for r in got if r["found"] >= 0}
    out: list[Estimate] = []
    rest = list(range(len(rules)))
    while rest:
        rejected = {k: sum(n for s, n in sets.items() if s >> k & 1) for k in rest}
        best = max(rest, key=lambda k: (rejected[k] / max(seconds.get(k, 0.0), 1e-9), -seconds.get(k, 0.0), -k))
        out.append(Estimate(rules[best], seconds.get(best, 0.0), rejected[best]))
        sets = {s: n for s, n in sets.items() if not s >> best & 1}
        rest.remove(best)
    return out


def cascade(docs: DataFrame, order: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and verdict of every whole text.

    Returns one row per input row: ``doc_id``; ``n_words``; ``word_chars``
    (code points in words); ``n_symbols``; ``n_dup_lines`` (lines with a word
    that equal an earlier line); ``n_repeat_words`` (words in 8-word windows
    found twice or more in the text); ``base_failed`` (under 20 words, or more
    than 30 % of them in repeated windows); ``rejected_by`` (the first rule of
    ``order`` that rejects the text; null if none, or if the base failed) and
    ``kept`` (neither failed nor rejected).

    A null text has no words and fails the base.  Null ids and repeated rows
    come out like any others; an empty table gives an empty result; other
    columns of ``docs`` are not looked at.  Equality of windows is equality of
    64-bit hashes.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, c, failed, text in _texts(part.column(1).to_pylist()):
                verdict: list[str | None] = [None] * len(failed)
                for i in np.flatnonzero(~failed):
                    t = text(i)
                    verdict[i] = next((rule.__name__ for rule in order if rule(t)), None)
                kept = [not f and v is None for f, v in zip(failed.tolist(), verdict)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(lo, len(failed)), *[pa.array(c[n], pa.int64()) for n in names],
                     pa.array(failed), pa.array(verdict, pa.string()), pa.array(kept)],
                    names=["doc_id", *names, "base_failed", "rejected_by", "kept"])

    table = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([table.schema["doc_id"]] + T.StructType.fromDDL(
        ", ".join(f"{n} long" for n in names) + ", base_failed boolean, rejected_by string, kept boolean").fields)
    return table.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`cascade` in the order that :func:`order_rules` finds."""
    order = [e.rule for e in order_rules(docs, rules, sample_rows, id_col, text_col)]
    return cascade(docs, order, id_col, text_col)
