"""Language-model scores of texts by a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class, given the tokens before it,
times that of its cell in the class, given them too, times its share of the
cell.  Classes group words by their ending and are found by clustering the
endings' neighbours; cells are hashed groups of the words of a class.  Class
and cell are softmax models over hashed features of the context (the last
word, the word before it with one skipped, the last two classes, the last two
words; for the cell each together with the class).  The share of the cell
comes from the counts of the whole corpus.

Both are trained by distributed gradient steps.  Texts are dealt into shares
by a hash, so many as their length asks for; a task takes its share's steps in
the order of the hash, and the changes of each feature's weights are averaged
by how often the share met it.  Sums are made in integers.  So the model is
the same however the table is partitioned.

Counts: tasks count the distinct words of groups of texts, and the counts are
summed by word hash.  The most frequent words (a bounded table) go to every
task; the hashes of a text's other words are kept in an array, joined to the
counts and summed per text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops.llm.common import Words, chunks_by_size, mix64, release_memory, scratch_path, word_hashes

CLASSES = 32
ENDINGS = 2048          # hashed word endings, which make up the classes
NEIGHBOURS = 64         # hashed neighbouring endings that describe an ending
CELLS = 16              # hashed groups of the words of a class
BUCKETS = 1 << 14       # rows of hashed features, at least; a power of two, as many as TOKENS_A_BUCKET asks for
MOST_BUCKETS = 1 << 17  # and at most: the tables go to every task
TOKENS_A_BUCKET = 512
ROUNDS = 2              # each trains on another part of the documents; together on all
CHARS_A_ROW = 384       # of the training texts of all rounds in a share, for each row of the tables that it sends back
STEP = 0.2              # of AdaGrad
BATCH = 8192            # tokens of a gradient step
SENT_WORDS = 200_000    # most frequent words whose counts go to every task
GROUP_CHARS = 4_000_000
BLOCKS = 64             # row blocks of matrices on their way between tasks

END = np.uint64(0x5851F42D4C957F2D)  # stands for a text's end


@dataclass
class Weights:
    """Of the classes and the cells: tables by hashed feature, with AdaGrad's sum for each row."""
    classes: np.ndarray        # rows x CLASSES; the last row is no feature's but the bias
    seen_classes: np.ndarray
    cells: np.ndarray          # rows x CELLS
    seen_cells: np.ndarray

    @staticmethod
    def of(buckets: int) -> "Weights":
        return Weights(np.zeros((buckets + 1, CLASSES), np.float32), np.full(buckets + 1, 1e-3, np.float32),
                       np.zeros((buckets + 1, CELLS), np.float32), np.full(buckets + 1, 1e-3, np.float32))

    def tables(self) -> tuple[np.ndarray, ...]:
        return self.classes, self.seen_classes, self.cells, self.seen_cells

    @property
    def buckets(self) -> int:
        return len(self.classes) - 1


@dataclass
class Model:
    classes: np.ndarray        # of each ending
    weights: Weights
    cell_log: np.ndarray       # log10(tokens + words + 1) of each class and cell
    hashes: np.ndarray         # sorted hashes of the most frequent words
    counts: np.ndarray         # their counts
    train_tokens: int = 0
    vocabulary: int = 0


class Tokens:
    """The tokens of some texts: each text's words, A-Z lowered, then one end."""

    def __init__(self, texts: list[str | None]):
        w = Words(texts, lower=True)
        n = len(texts)
        place = np.arange(len(w.starts)) + w.doc
        ends = w.last + np.arange(n)
        self.n_tokens = w.n_words + 1
        self.doc = np.repeat(np.arange(n), self.n_tokens)
        self.first = ends + 1 - self.n_tokens
        self.hash = np.full(len(place) + n, END, dtype=np.uint64)
        self.hash[place] = word_hashes(w.data, w.starts, w.ends)
        tail = np.zeros(len(place), dtype=np.uint64)
        size = w.ends - w.starts
        for k in range(1, 4):  # the last three bytes
            byte = w.data.take(w.ends - k, mode="clip").astype(np.uint64)
            tail |= np.where(size >= k, byte << np.uint64(8 * k), np.uint64(0))
        self.ending = np.zeros(len(self.hash), dtype=np.int64)  # ending 0 is the end's own
        self.ending[place] = 1 + (mix64(tail) % np.uint64(ENDINGS - 1)).astype(np.int64)
        self._contexts: tuple | None = None
        self.cell = (mix64(self.hash + np.uint64(1)) & np.uint64(CELLS - 1)).astype(np.int64)

    def back(self, values: np.ndarray, by: int, blank) -> np.ndarray:
        """``values`` of the tokens ``by`` places earlier in the same text, else ``blank``."""
        out = np.empty_like(values)
        out[by:] = values[:-by] if by < len(values) else values[:0]
        for k in range(by):  # the first tokens of each text
            out[self.first[self.n_tokens > k] + k] = blank
        return out

    def contexts(self, classes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Four 64-bit values that describe each token's context (kept for the next call with the same classes)."""
        if self._contexts is None or self._contexts[0] is not classes:
            self._contexts = classes, self._describe(classes)
        return self._contexts[1]

    def _describe(self, classes: np.ndarray) -> tuple[np.ndarray, ...]:
        h1, h2 = self.back(self.hash, 1, 0), self.back(self.hash, 2, 0)
        c = classes[self.ending].astype(np.uint64)
        c1, c2 = self.back(c, 1, CLASSES), self.back(c, 2, CLASSES)
        return (h1, h2 + np.uint64(1), c1 * np.uint64(CLASSES + 1) + c2 + np.uint64(1 << 40),
                h1 * np.uint64(0x9E3779B97F4A7C15) + h2)

    def features(self, classes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
        """Rows of the context features among ``buckets``, a power of two: tokens x 4."""
        return np.stack([(mix64(x * np.uint64(2 * i + 3)) & np.uint64(buckets - 1)).astype(np.int64)
                         for i, x in enumerate(self.contexts(classes))], axis=1)

    def cell_features(self, classes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
        """Rows of the context features with the token's own class, and of the class alone: tokens x 5."""
        own = (classes[self.ending].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.stack([(mix64((x ^ own) * np.uint64(2 * i + 11)) & np.uint64(buckets - 1)).astype(np.int64)
                         for i, x in enumerate((*self.contexts(classes), np.zeros_like(own)))], axis=1)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def _blocks(matrix: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.array_split(matrix, BLOCKS)]


# -------------------------------------------------------------------- counts

def count_words(docs: DataFrame) -> DataFrame:
    """From ``text``: rows (hash, ending, cell, n) of distinct words per task, and per task BLOCKS rows (block, cells).

    ``cells`` counts the endings on both sides of each ending.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "ending", "cell", "n", "block", "cells"]
        near = np.zeros((ENDINGS, 2 * NEIGHBOURS), np.float32)
        for part in parts:
            texts = part.column(0).to_pylist()
            for lo, hi in chunks_by_size(texts, GROUP_CHARS):
                t = Tokens(texts[lo:hi])
                order = np.argsort(t.hash)
                ordered = t.hash[order]
                starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                values, at, n = ordered[starts], order[starts], np.diff(np.append(starts, len(ordered)))
                none = pa.nulls(len(values))
                yield _batch(names, pa.array(values.view(np.int64)), pa.array(t.ending[at], pa.int32()),
                             pa.array(t.cell[at], pa.int32()), pa.array(n),
                             none.cast(pa.int32()), none.cast(pa.binary()))
                left, right = t.ending[:-1], t.ending[1:]
                same = t.doc[:-1] == t.doc[1:]
                left, right = left[same], right[same]
                for of, by, shift in ((right, left, 0), (left, right, NEIGHBOURS)):
                    cell = of * (2 * NEIGHBOURS) + by % NEIGHBOURS + shift
                    near += np.bincount(cell, minlength=near.size).reshape(near.shape)
        if near.any():
            none = pa.nulls(BLOCKS)
            yield _batch(names, none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int64()),
                         pa.array(range(BLOCKS), pa.int32()), pa.array(_blocks(near), pa.binary()))

    return docs.select("text").mapInArrow(run, "hash long, ending int, cell int, n long, block int, cells binary")


def _sum_blocks(rows: DataFrame, columns: int) -> np.ndarray:
    """Sum of matrices of whole numbers that arrive as rows (block, cells); no row if none arrives."""
    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # the blocks of this partition; rows stream by
        for part in parts:
            for block, cells in zip(*(c.to_pylist() for c in part.columns)):
                sums[block] = sums.get(block, 0.0) + np.frombuffer(cells, np.float32).astype(np.float64)
        yield _batch(["block", "cells"], pa.array(list(sums), pa.int32()),
                     pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary()))

    got = rows.select("block", "cells").repartition(BLOCKS, "block").mapInArrow(add, "block int, cells binary").collect()
    cells = [np.frombuffer(r["cells"], np.float32) for r in sorted(got, key=lambda r: r["block"])]
    return np.concatenate([np.empty(0, np.float32), *cells]).reshape(-1, columns)


def cluster_endings(near: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Classes of the endings: k-means of their neighbours' shares, weighted by how often they occur."""
    often = near.sum(axis=1)
    x = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))  # Hellinger distance
    order = np.argsort(-often, kind="stable")
    centres = x[order[:1]]
    weight = np.sqrt(often)
    for _ in range(CLASSES - 1):  # each further centre: far from the others, and frequent
        far = ((x[:, None, :] - centres[None, -1:, :]) ** 2).sum(axis=2)[:, 0]
        least = far if len(centres) == 1 else np.minimum(least, far)
        centres = np.concatenate((centres, x[[int(np.argmax(least * weight))]]))
    for _ in range(rounds):
        distance = (x ** 2).sum(1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(1)[None]
        nearest = distance.argmin(axis=1)
        mass = np.bincount(nearest, often, minlength=CLASSES)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x * often[:, None])
        filled = mass > 0
        centres[filled] = sums[filled] / mass[filled, None]
    return nearest


# ------------------------------------------------------------------ training

def _logits(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Sums of the features' rows, kept within what exp() can take."""
    out = np.take(weights, features[:, 0], axis=0, mode="clip")  # rows are in range; "clip" skips the check
    more = np.empty_like(out)
    for k in range(1, features.shape[1]):
        out += np.take(weights, features[:, k], axis=0, out=more, mode="clip")
    out += bias
    return np.clip(out, -80, 80, out=out)


def _sums(p: np.ndarray, order: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``p``, in ``order``, that begin at ``starts``; most are of one row."""
    out = np.take(p, order[starts], axis=0, mode="clip")
    more = np.flatnonzero(count > 1)
    if len(more):
        rows = order[np.repeat(count > 1, count)]
        out[more] = np.add.reduceat(np.take(p, rows, axis=0, mode="clip"), np.cumsum(count[more]) - count[more], axis=0)
    return out


def _step(weights: np.ndarray, seen: np.ndarray, hits: np.ndarray, rows: np.ndarray, gold: np.ndarray, bias: int = 0) -> None:
    """One AdaGrad step of a softmax on some tokens; ``hits`` counts the tokens of each row; ``bias``: a row of all tokens."""
    p = _logits(weights, weights[bias] if bias else np.float32(0), rows)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    n = len(gold)
    place = np.arange(n)
    p[place, gold] -= 1  # the gradient of minus the log-likelihood
    p *= np.float32(1 / np.sqrt(n))
    for k in range(rows.shape[1] + bool(bias)):  # kind by kind: the gradients stay in the cache
        if k == rows.shape[1]:
            hit, count, g = np.array([bias]), n, p.sum(axis=0, keepdims=True)
        else:
            keys = np.sort((rows[:, k] << 20) | place)
            at = keys >> 20
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            hit, count = at[starts], np.diff(np.append(starts, n))
            g = _sums(p, keys & 0xFFFFF, starts, count)
        hits[hit] += count
        rate = seen[hit] + np.einsum("ij,ij->i", g, g) / p.shape[1]  # one rate for a feature's row
        seen[hit] = rate
        g *= (STEP / np.sqrt(rate))[:, None]
        weights[hit] = np.take(weights, hit, axis=0, mode="clip") - g


_UNIT = 2.0 ** 24       # half-precision numbers are multiples of its inverse
_SEEN_UNIT = 2.0 ** 20


def _changes(new: np.ndarray, old: np.ndarray, hits: np.ndarray, seen: np.ndarray, seen_old: np.ndarray) -> list[bytes]:
    """What a share did to a table, in blocks of rows: changes in half precision, hits, growth of AdaGrad's sums."""
    parts = (np.clip(new - old, -64, 64).astype(np.float16), hits.astype(np.uint32), (seen - seen_old).astype(np.float32))
    return [b"".join(x.tobytes() for x in block) for block in zip(*(np.array_split(p, BLOCKS) for p in parts))]


def _change(data: bytes, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The changes times the hits, the hits and the growth, as whole numbers."""
    n = len(data) // (2 * columns + 8)
    moved = np.frombuffer(data, np.float16, n * columns).reshape(n, columns).astype(np.float64)
    hits = np.frombuffer(data, np.uint32, n, 2 * n * columns).astype(np.int64)
    grown = np.frombuffer(data, np.float32, n, 2 * n * columns + 4 * n).astype(np.float64)
    return (moved * _UNIT).astype(np.int64) * hits[:, None], hits, np.round(grown * _SEEN_UNIT).astype(np.int64)


def train(docs: DataFrame, classes: np.ndarray, weights: Weights, shares: int) -> Weights:
    """One round over ``text`` rows with their ``share`` and ``place``: all shares step from the same weights."""
    sent = docs.sparkSession.sparkContext.broadcast((classes, weights))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, start = sent.value
        release_memory()

        def fresh():
            hits = np.zeros(start.buckets + 1, np.int64), np.zeros(start.buckets + 1, np.int64)
            return Weights(*(x.copy() for x in start.tables())), hits

        def moved(w: Weights, hits) -> pa.RecordBatch:
            blocks = (_changes(w.classes, start.classes, hits[0], w.seen_classes, start.seen_classes),
                      _changes(w.cells, start.cells, hits[1], w.seen_cells, start.seen_cells))
            return _batch(["block", "classes", "cells"], pa.array(range(BLOCKS), pa.int32()),
                          *(pa.array(b, pa.binary()) for b in blocks))

        def learn(texts: list[str], w: Weights, hits) -> None:
            t = Tokens(texts)
            gold = classes[t.ending]
            rows = t.features(classes, start.buckets)
            cell_rows = t.cell_features(classes, start.buckets)
            for a in range(0, len(gold), BATCH):
                step = slice(a, a + BATCH)
                _step(w.classes, w.seen_classes, hits[0], rows[step], gold[step], start.buckets)
                _step(w.cells, w.seen_cells, hits[1], cell_rows[step], t.cell[step])

        share, held = None, []  # texts come by share, in the order of their hash; groups do not depend on the batches
        size = 0
        w, hits = None, None
        for part in parts:
            for of, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if of != share:
                    if held:
                        learn(held, w, hits)
                    if w:
                        yield moved(w, hits)
                    (w, hits), share, held, size = fresh(), of, [], 0
                held.append(text)
                size += len(text or "")
                if size >= GROUP_CHARS:
                    learn(held, w, hits)
                    held, size = [], 0
        if held:
            learn(held, w, hits)
        if w:
            yield moved(w, hits)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}  # the blocks of this partition; rows stream by
        for part in parts:
            for block, *tables in zip(*(c.to_pylist() for c in part.columns)):
                got = [x for data, n in zip(tables, (CLASSES, CELLS)) for x in _change(data, n)]
                sums[block] = [a + b for a, b in zip(sums[block], got)] if block in sums else got

        def tables(moved, hits, grown):
            return ((moved / np.maximum(hits, 1)[:, None] / _UNIT).astype(np.float32).tobytes()
                    + (grown / _SEEN_UNIT).astype(np.float32).tobytes())
        yield _batch(["block", "classes", "cells"], pa.array(list(sums), pa.int32()),
                     *(pa.array([tables(*x[i:i + 3]) for x in sums.values()], pa.binary()) for i in (0, 3)))

    schema = "block int, classes binary, cells binary"
    got = (docs.repartitionById(shares, F.col("share")).sortWithinPartitions("share", "place").select("share", "text")
           .mapInArrow(run, schema).repartition(BLOCKS, "block").mapInArrow(add, schema).collect())
    sent.unpersist()
    if not got:
        return weights
    new = []
    for name, columns, tables in (("classes", CLASSES, weights.tables()[:2]), ("cells", CELLS, weights.tables()[2:])):
        parts = [np.frombuffer(r[name], np.float32) for r in sorted(got, key=lambda r: r["block"])]
        cut = [len(p) // (columns + 1) * columns for p in parts]
        new.append(tables[0] + np.concatenate([p[:c] for p, c in zip(parts, cut)]).reshape(-1, columns))
        new.append(tables[1] + np.concatenate([p[c:] for p, c in zip(parts, cut)]))
    return Weights(*new)


# ------------------------------------------------------------------- scoring

def _frequent(counts: DataFrame) -> DataFrame:
    """(hash, n) of the most frequent words, SENT_WORDS at most: those from an eighth of an octave on.

    The words per step of counts are a few hundred rows, so nothing is sorted.
    """
    step = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > SENT_WORDS:
            break
        least = r["step"]
    return counts.where(step >= least if least is not None else F.lit(False)).select("hash", "n")


def token_logs(model: Model, t: Tokens) -> np.ndarray:
    """log10 of the probability of each token's class and cell, given its context."""
    cls, w, out = model.classes[t.ending], model.weights, np.zeros(len(t.ending))
    none = np.zeros(CELLS, np.float32)
    for weights, bias, rows, gold in ((w.classes, w.classes[-1], t.features(model.classes, w.buckets), cls),
                                      (w.cells, none, t.cell_features(model.classes, w.buckets), t.cell)):
        for a in range(0, len(gold), BATCH):
            x = _logits(weights, bias, rows[a:a + BATCH])
            own = x[np.arange(len(x)), gold[a:a + BATCH]].astype(np.float64)
            out[a:a + BATCH] += own - np.log(np.exp(x, out=x).sum(axis=1).astype(np.float64))
    return out / math.log(10)


def _score_batches(model: Model):
    """A function from batches of (carried..., text) to rows with the known parts of the scores."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        number = TaskContext.get().partitionId() << 40
        for part in parts:
            texts = part.column(part.num_columns - 1).to_pylist()
            for lo, hi in chunks_by_size(texts, GROUP_CHARS // 2):
                t, n = Tokens(texts[lo:hi]), hi - lo
                score = token_logs(m, t) - m.cell_log[m.classes[t.ending], t.cell]
                at = np.minimum(np.searchsorted(m.hashes, t.hash), max(len(m.hashes) - 1, 0))
                sent = m.hashes[at] == t.hash if len(m.hashes) else np.zeros(len(t.hash), bool)
                counts = np.where(sent, m.counts[at], 0) if len(m.hashes) else np.zeros(len(t.hash))
                logs = np.bincount(t.doc, np.log10(counts + 1.0), minlength=n)
                known = np.bincount(t.doc[sent], minlength=n)
                rare = t.hash[~sent].view(np.int64)
                ends = np.cumsum(np.bincount(t.doc[~sent], minlength=n))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(rare))
                own = [part.column(i).slice(lo, n) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(number + np.arange(n)), pa.array(t.n_tokens), pa.array(known.astype(np.int64)),
                     pa.array(logs), pa.array(np.bincount(t.doc, score, minlength=n)), lists],
                    names=[*part.schema.names[:-1], "row", "n_tokens", "sent_known", "sent_logs", "class_score", "rare"])
                number += n

    return run


def fit_and_score(docs: DataFrame, learn: Column, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  rounds: int = ROUNDS, id_col: str = "doc_id") -> DataFrame:
    """Fit the model on all rows where ``learn`` holds and score every whole text.

    Returns one row per input row: the ``keep`` columns; ``n_tokens`` (words
    and one end); ``n_known`` (tokens met in training); ``train_tokens`` (of
    all training texts); ``base_score`` (sum of log10((c + 1) / (N + V + 1))
    with the token's count c, all counts N and V distinct training tokens) and
    ``score``, the log10 probability of the text by the model.

    A null or empty text is its end alone.  A ``learn`` that is null counts as
    false.  Without a training text all counts are 0, and the classes and cells
    are equally likely.  Null ids and repeated rows are scored, and learned from,
    like any others; an empty table gives an empty result; columns of ``docs``
    other than the id, the text and ``keep`` are not looked at.  Scores do not
    depend on how the rows are partitioned or ordered.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    training = docs.where(F.coalesce(learn, F.lit(False)))

    found = scratch_path(spark, "lm-found")
    count_words(training.select(text.alias("text"))).write.parquet(found)
    rows = spark.read.parquet(found)
    counts_at = scratch_path(spark, "lm-counts")
    (rows.where("hash is not null").groupBy("hash").agg(F.sum("n").alias("n"), F.min("ending").alias("ending"), F.min("cell").alias("cell"))
     .write.parquet(counts_at))
    counts = spark.read.parquet(counts_at)
    near = _sum_blocks(rows.where("block is not null").select("block", "cells"), 2 * NEIGHBOURS)
    classes = cluster_endings(near) if len(near) else np.zeros(ENDINGS, np.int64)

    by_cell = counts.groupBy("ending", "cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    train_tokens, vocabulary = sum(r["n"] for r in by_cell), sum(r["words"] for r in by_cell)
    sums = np.zeros((CLASSES, CELLS))
    for r in by_cell:  # ENDINGS x CELLS rows at most
        sums[classes[r["ending"]], r["cell"]] += r["n"] + r["words"]

    # both follow from the training texts alone, not from how they are partitioned
    buckets = min(MOST_BUCKETS, max(BUCKETS, 1 << (train_tokens // TOKENS_A_BUCKET).bit_length()))
    chars = training.agg(F.sum(F.length(text))).first()[0] or 0
    shares = max(1, -(-chars // (CHARS_A_ROW * buckets)))
    place = F.xxhash64(F.col(id_col), text)
    dealt = training.select(F.pmod(place, F.lit(shares)).cast("int").alias("share"), place.alias("place"), text.alias("text"),
                            F.pmod(F.xxhash64(F.lit("round"), place), F.lit(rounds)).alias("part"))
    weights = Weights.of(buckets)
    for r in range(rounds if train_tokens else 0):
        weights = train(dealt.where(F.col("part") == r).drop("part"), classes, weights, shares)

    top = _frequent(counts).toArrow()
    hashes = top.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    model = Model(classes, weights, np.log10(sums + 1), hashes[order], top.column("n").to_numpy()[order], train_tokens, vocabulary)

    table = docs.select(*keep, text.alias("_text"))
    scored_at = scratch_path(spark, "lm-scored")
    schema = T.StructType([table.schema[c] for c in keep] + T.StructType.fromDDL(
        "row long, n_tokens long, sent_known long, sent_logs double, class_score double, rare array<long>").fields)
    table.mapInArrow(_score_batches(spark.sparkContext.broadcast(model)), schema).write.parquet(scored_at)
    scored = spark.read.parquet(scored_at)
    rest = (scored.select("row", F.explode("rare").alias("rare_hash"))
            .join(counts.select("hash", "n"), F.col("rare_hash") == F.col("hash"))
            .groupBy(F.col("row").alias("rest_row"))
            .agg(F.count(F.lit(1)).alias("rest_known"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("rest_logs")))
    logs = F.col("sent_logs") + F.coalesce("rest_logs", F.lit(0.0))
    unit = math.log10(model.train_tokens + model.vocabulary + 1)
    return (scored.drop("rare").join(rest, F.col("row") == F.col("rest_row"), "left")
            .select(*keep, "n_tokens", (F.col("sent_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
                    F.lit(model.train_tokens).cast("long").alias("train_tokens"),
                    (logs - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
                    (F.col("class_score") + logs).alias("score")))
