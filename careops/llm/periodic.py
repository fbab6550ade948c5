"""Runs of periodically repeated words by Lyndon roots (Baier's grouping).

The first phase of Baier's suffix sorter gathers suffixes in groups, from the
highest group down: the members of a group pull the closest earlier suffix of
a lower group into a new group above its old one and lengthen its prefix by
theirs.  A suffix's prefix at the end is its longest Lyndon prefix, so the
phase yields the Lyndon array by itself.  Done under an order of the words and
under the opposite one, it holds a root of every run; a root is extended to
both sides by longest common extensions, from names of blocks of 2, 4, 8...
words.

A run of at least ``least`` words consists of windows of ceil(least / 2) words
that occur twice or more in the document, so only stretches of such windows
are looked at.  They are found by hashes, which can only add stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops.llm.common import Words, chunks_by_size, cover, mix64, release_memory, window_hashes, word_hashes

LEAST = 12
GROUP_CHARS = 2_000_000


def lyndon_array(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position of a sequence of dense ranks (Baier's first phase)."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    suffixes = order.tolist()  # group by group, the lowest first
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    first = np.searchsorted(ranks[order], ranks)
    group = first.tolist()     # a group's name is its first place
    size = np.bincount(first, minlength=n).tolist()
    length, before = [1] * n, [-1] * n
    end = n
    while end:
        start = group[suffixes[end - 1]]
        members = suffixes[start:end]
        members.sort()
        pulls: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                pulls[j] = pulls.get(j, 0) + 1
        grown = length[members[0]]
        end = start
        while pulls:
            most = max(pulls.values())
            parts: dict[int, list[int]] = {}
            for j, times in pulls.items():
                if times == most:
                    parts.setdefault(group[j], []).append(j)
            for old, part in parts.items():
                left = size[old] - len(part)
                new = old + left
                if left:
                    to = new + len(part)
                    for j in part:
                        to -= 1
                        at, other = place[j], suffixes[to]
                        suffixes[at], place[other] = other, at
                        suffixes[to], place[j] = j, to
                    size[old], size[new] = left, len(part)
                for j in part:
                    group[j] = new
                    length[j] += most * grown
            if most == 1:
                break
            pulls = {j: times for j, times in pulls.items() if times < most}
    return np.array(length, np.int64)


class Extensions:
    """Longest common extensions of pairs of positions, by names of blocks whose lengths are powers of two."""

    def __init__(self, ranks: np.ndarray):
        self.n = len(ranks)
        self.names = [ranks.astype(np.int32)]
        while True:  # until no block occurs twice
            last, step = self.names[-1], 1 << (len(self.names) - 1)
            if len(last) <= step:
                break
            both = last[:-step].astype(np.int64) * self.n + last[step:]
            values, names = np.unique(both, return_inverse=True)
            if len(values) == len(both):
                break
            self.names.append(names.astype(np.int32))

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a < b on are equal."""
        a, start = a.copy(), a
        gap = b - a
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            fits = a + gap < len(names)
            fits[fits] = names[a[fits]] == names[(a + gap)[fits]]
            a[fits] += 1 << k
        return a - start

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to and with a < b are equal."""
        a, start = a.copy(), a
        gap = b - a
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            fits = a - step + 1 >= 0
            at = a[fits] - step + 1
            fits[fits] = names[at] == names[at + gap[fits]]
            a[fits] -= step
        return start - a


def runs(ranks: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) rows of all runs of at least ``max(least, 2 * period)``, by start, then period."""
    n, top = len(ranks), int(ranks.max(initial=0))
    at = np.arange(n)
    roots = []
    for ordered in (ranks, top - ranks):
        period = lyndon_array(ordered)
        near = np.flatnonzero(at + period < n)
        gap = period[near]
        # the root must go on by a word at least, to one side or the other
        near = near[(ranks[near] == ranks[near + gap]) | ((near > 0) & (ranks[near - 1] == ranks[near + gap - 1]))]
        roots.append(np.stack((near, period[near])))
    at, period = np.unique(np.concatenate(roots, axis=1), axis=1)
    if not len(at):
        return np.empty((0, 3), np.int64)
    same = Extensions(ranks)
    start = at - same.left(at - 1, at + period - 1)
    size = at + period + same.right(at, at + period) - start
    found = np.stack((start, size, period), axis=1)[size >= np.maximum(least, 2 * period)]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _stretches(w: Words, window: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(document, first, last) of the stretches of words in windows that their document has twice or more."""
    hashes = window_hashes(word_hashes(w.data, w.starts, w.ends), window)
    at = w.windows(hashes, window)
    if not len(at):
        return
    keys = hashes[at] ^ mix64(w.doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = cover(at[twice], len(w.starts), window)
    for doc in np.unique(w.doc[at[twice]]).tolist():
        lo, hi = int(w.first[doc]), int(w.last[doc])
        turns = np.flatnonzero(np.diff(np.concatenate(([0], inside[lo:hi].view(np.int8), [0])))) + lo
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if b - a >= least:
                yield doc, a, b


def text_runs(texts: list[str | None], least: int = LEAST) -> tuple[Words, dict[int, np.ndarray]]:
    """The words of some texts, and the runs of each text that has any."""
    w = Words(texts)
    found: dict[int, list[np.ndarray]] = {}
    for doc, a, b in _stretches(w, -(-least // 2), least):
        codes: dict[bytes, int] = {}
        spans = zip(w.starts[a:b].tolist(), w.ends[a:b].tolist())
        ranks = np.array([codes.setdefault(w.joined[s:e], len(codes)) for s, e in spans], np.int64)
        got = runs(ranks, least)
        if len(got):
            got[:, 0] += a - w.first[doc]
            found.setdefault(doc, []).append(got)
    return w, {doc: np.concatenate(parts) for doc, parts in found.items()}


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Find the periodic runs of each text and collapse them.

    A run is a stretch of words, not to be extended, with smallest period q
    and at least ``max(least, 2 * q)`` words.  Returns one row per input row:
    ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then
    period; starts are word numbers from 0), ``collapsed`` (the words joined by
    one space, without those that lie in a run after its first q words) and
    the ``keep`` columns.

    A null or wordless text has no run and an empty ``collapsed``.  Rows with
    null or repeated ids are texts of their own.  An empty table gives an empty
    result; other columns of ``docs`` are not looked at.  A text is worked on
    as a whole: a task needs some 100 bytes for each word of its longest text.
    """
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def collapse(w: Words, doc: int, found: np.ndarray) -> str:
        lo, hi = int(w.first[doc]), int(w.last[doc])
        steps = np.zeros(hi - lo + 1, np.int64)
        np.add.at(steps, found[:, 0] + found[:, 2], 1)
        np.add.at(steps, found[:, 0] + found[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(steps)[:-1] == 0) + lo
        return b" ".join([w.joined[s:e] for s, e in zip(w.starts[kept].tolist(), w.ends[kept].tolist())]).decode()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for part in parts:
            texts = part.column(1).to_pylist()
            for lo, hi in chunks_by_size(texts, GROUP_CHARS):
                w, found = text_runs(texts[lo:hi], least)
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in found[i].tolist()] if i in found else []
                        for i in range(hi - lo)]
                lines = [collapse(w, i, found[i]) if i in found else b" ".join((t or "").encode().split()).decode()
                         for i, t in enumerate(texts[lo:hi])]
                piece = part.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(w.n_words, pa.int64()), pa.array(rows, run_type), pa.array(lines, pa.string()),
                     *piece.columns[2:]], names=["doc_id", "n_words", "runs", "collapsed", *keep])

    schema = T.StructType.fromDDL("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
                                  "collapsed string")
    return table.mapInArrow(run, T.StructType(schema.fields + [table.schema[c] for c in keep]))
