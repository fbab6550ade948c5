"""Language identification by a linear-chain conditional random field over words.

A word's features are its character n-grams, its affixes (n-grams that touch a
word end) and its entry in a lexicon of frequent words, all hashed; their
weights add up to a score for each language.  Learned transitions tie the
labels of neighbouring words together, and forward-backward gives each word's
label probabilities in its whole text.  Training texts are known by their
language only, so the training sequences are code-switched ones, made of
stretches of texts in different languages.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careops.llm.common import bounded_sample, chunks_by_size, release_memory

SAMPLE_ROWS = 3000      # documents that the model is fitted on
BUCKETS = 1 << 16       # hashed features
PARTS = 4               # tasks that train side by side
ROUNDS = 3              # averages of their weights
NGRAMS = (1, 2, 3, 4)
LEXICON = 20_000        # frequent words of the sample that have a feature of their own
STEPS = 32              # words of a block in forward-backward
SEQUENCE = 128          # words of a training sequence
CACHE_WORDS = 200_000
GROUP_CHARS = 1_000_000
LEAST_TEXTS = 100       # labelled texts of the sample from which on there is a calibration
LOWEST = 1              # percentile of the sample's texts that calibrates
PART_CHARS = 16_000_000  # of a part where a model is fitted on all rows
TRAIN_CHARS = 4_000_000  # of a part that are held at a time
UNIT = 1 << 16          # steps of a weight, for sums that don't depend on their order
GRID = 10_000           # steps of a share, for percentiles of all texts


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray     # BUCKETS x labels
    transitions: np.ndarray  # labels x labels, log scale
    lexicon: np.ndarray     # sorted hashes of words
    seen: np.ndarray | None = None  # buckets of the sample's features
    low_known: float = 0.0  # ``known`` of the sample's texts, at LOWEST per cent of them; 0: no calibration
    low_score: float = 0.0  # their score


def clean(token: str) -> str:
    """The letters of a token."""
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


class _Words(dict):
    """Token numbers; a token met for the first time is put on ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        self.new.append(token)
        return n


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, concatenated, and the word that each belongs to."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marked = "".join(["\x02" + w + "\x03" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    found, owners = [], []
    rolled = codes + np.uint64(1)
    for n in NGRAMS:
        if n > 1:
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + codes[n - 1:] + np.uint64(1)
        if n > len(codes):
            break
        inside = owner[:len(rolled)] == owner[n - 1:]
        if n == 1:
            inside = inside & (codes > 3)
        found.append(_bucket(rolled[inside], n))
        owners.append(owner[:len(rolled)][inside])
    whole = whole_hashes(codes, sizes)
    known = np.flatnonzero(_within(whole, lexicon))
    found.append(_bucket(whole[known], 9))
    owners.append(known)
    return np.concatenate(found), np.concatenate(owners)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 16)).astype(np.int64)


def whole_hashes(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    powers = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
    return np.add.reduceat(codes * powers[place], np.cumsum(sizes) - sizes)


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def emissions(words: list[str], weights: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Summed feature weights: words x labels."""
    index, owner = features(words, lexicon)
    return np.stack([np.bincount(owner, weights[index, k], minlength=len(words))
                     for k in range(weights.shape[1])], axis=1).astype(np.float32)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward values of each word, scaled by word; exact over whole texts of any length.

    ``scores`` has the words of all texts one after the other.  Texts are cut
    into blocks of STEPS words; a product of the block's matrices carries the
    chain across it, so that all blocks advance side by side and only block
    ends are met one after the other.
    """
    n_labels = scores.shape[1]
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros((0, n_labels)), np.zeros((0, n_labels))
    per = -(-lengths // STEPS)
    n = int(per.sum())
    first = np.cumsum(per) - per                              # each text's first block
    k_of = np.arange(n) - np.repeat(first, per)               # a block's place in its text
    filled = np.minimum(STEPS, np.repeat(lengths, per) - k_of * STEPS)
    mask = np.arange(STEPS)[None, :] < filled[:, None]
    e = np.ones((n, STEPS, n_labels))
    e[mask] = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(transitions - transitions.max())
    start = k_of == 0
    m = np.broadcast_to(np.eye(n_labels), (n, n_labels, n_labels)).copy()
    full = mask.all(axis=0)                                   # steps that every block has
    for t in range(STEPS):
        on = slice(None) if full[t] else mask[:, t]
        step = m[on] @ a * e[on, t][:, None, :]
        if t == 0:
            step[start] = m[start] * e[start, 0][:, None, :]  # no transition into a text's first word
            m = step / step.max(axis=(1, 2), keepdims=True)
        else:
            m[on] = step / step.max(axis=(1, 2), keepdims=True)
    into = np.full((n, n_labels), 1.0 / n_labels)             # forward values before each block
    after = np.ones((n, n_labels))                            # backward values behind each block
    order = np.argsort(k_of, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(k_of))[:-1])
    for here in levels[1:]:
        x = np.einsum("ni,nij->nj", into[here - 1], m[here - 1])
        into[here] = x / x.sum(axis=1, keepdims=True)
    for here in levels[:0:-1]:
        x = np.einsum("nij,nj->ni", m[here], after[here])
        after[here - 1] = x / x.max(axis=1, keepdims=True)
    forward = np.empty((n, STEPS, n_labels))
    f = into
    for t in range(STEPS):
        g = f @ a
        if t == 0:
            g[start] = f[start]
        g = g * e[:, t]
        g /= g.sum(axis=1, keepdims=True)
        f = g if full[t] else np.where(mask[:, t][:, None], g, f)
        forward[:, t] = f
    backward = np.empty((n, STEPS, n_labels))
    b = after
    for t in range(STEPS - 1, -1, -1):
        backward[:, t] = b
        g = (b * e[:, t]) @ a.T
        g /= g.max(axis=1, keepdims=True)
        b = g if full[t] else np.where(mask[:, t][:, None], g, b)
    return forward[mask], backward[mask]


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of each word."""
    f, b = forward_backward(scores, lengths, transitions)
    f *= b
    return f / f.sum(axis=1, keepdims=True)


# ------------------------------------------------------------------ training

def _sequences(texts: list[str], labels: list[int], rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Code-switched sequences: stretches of 4 to 40 words of the texts, shuffled.  The distinct words, and each word's number and label."""
    tokens = _Words()
    split = [np.fromiter(map(tokens.__getitem__, t.lower().split()), np.int64) for t in texts]
    cleaned = list(map(clean, tokens.new))
    names = sorted({w for w in cleaned if w})
    number = {w: i for i, w in enumerate(names)}
    number_of = np.fromiter((number.get(w, -1) for w in cleaned), np.int64, len(cleaned))
    words = number_of[np.concatenate(split)] if split else np.empty(0, np.int64)
    real = np.concatenate(([0], np.cumsum(words >= 0)))
    ends = real[np.cumsum([len(x) for x in split], dtype=np.int64)]  # of each text among the words with a letter
    words = words[words >= 0]
    draws = np.cumsum(copy.deepcopy(rng).integers(4, 41, len(words) // 4 + len(texts) + 1))
    stops, whose, lo, used = [], [], 0, 0
    for end, label in zip(ends.tolist(), labels):
        if end > lo:  # stretches are drawn until the text is used up
            drawn = draws[used - 1] if used else 0
            n = int(np.searchsorted(draws, drawn + end - lo)) + 1 - used
            stops.append(np.minimum(lo + draws[used:used + n] - drawn, end))
            whose.append(np.full(n, label, np.int64))
            lo, used = end, used + n
    if not used:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    rng.integers(4, 41, used)
    stops, whose = np.concatenate(stops), np.concatenate(whose)
    sizes = np.diff(stops, prepend=0)
    order = rng.permutation(used)
    size = sizes[order]
    at = np.repeat((stops - sizes)[order] - (np.cumsum(size) - size), size) + np.arange(len(words))
    return names, words[at], np.repeat(whose[order], size)


def _unseen(n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((BUCKETS, n_labels), 1e-2), np.full((n_labels, n_labels), 1e-2)


def _train_part(texts: list[str], labels: list[int], weights: np.ndarray, transitions: np.ndarray,
                lexicon: np.ndarray, seed: int, seen: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One pass of AdaGrad steps on the log-likelihood of this task's sequences; ``seen`` goes on with earlier steps' squares."""
    names, which, gold = _sequences(texts, labels, np.random.default_rng(seed))
    weights, transitions = weights.astype(np.float64), transitions.copy()
    n_labels = weights.shape[1]
    if not names:
        return weights, transitions
    index, owner = features(names, lexicon)
    bounds = np.searchsorted(owner[(order := np.argsort(owner, kind="stable"))], np.arange(len(names) + 1))
    index = index[order]
    seen, seen_t = seen or _unseen(n_labels)
    batch = SEQUENCE * 32
    used, place = np.zeros(BUCKETS, bool), np.empty(BUCKETS, np.int64)
    for lo in range(0, len(which), batch):
        ids, y = which[lo:lo + batch], gold[lo:lo + batch]
        types, local = np.unique(ids, return_inverse=True)
        sizes = bounds[types + 1] - bounds[types]
        flat = np.repeat(bounds[types] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        feats, own = index[flat], np.repeat(np.arange(len(types)), sizes)
        emit = np.stack([np.bincount(own, w, minlength=len(types)) for w in weights[feats].T], 1)
        lengths = np.full(-(-len(ids) // SEQUENCE), SEQUENCE)
        lengths[-1] = len(ids) - SEQUENCE * (len(lengths) - 1)
        sc = emit[local]
        fwd, bwd = forward_backward(sc, lengths, transitions)
        p = fwd * bwd
        p /= p.sum(axis=1, keepdims=True)
        gain = -p
        gain[np.arange(len(ids)), y] += 1
        by_type = np.stack([np.bincount(local, gain[:, k], minlength=len(types)) for k in range(n_labels)], 1)
        used[feats] = True
        hit = np.flatnonzero(used)
        place[hit] = np.arange(len(hit))
        used[hit] = False
        at = place[feats]
        g = np.stack([np.bincount(at, v, minlength=len(hit)) for v in by_type[own].T], 1) / len(ids)
        seen[hit] += g * g
        weights[hit] += 0.1 * g / np.sqrt(seen[hit])
        # transitions: observed minus expected label pairs
        inner = np.arange(len(ids) - 1)
        inner = inner[(inner + 1) % SEQUENCE != 0]
        if len(inner):
            ahead = np.exp(sc - sc.max(axis=1, keepdims=True)) * bwd
            pair = (fwd[inner][:, :, None] * np.exp(transitions - transitions.max())[None]
                    * ahead[inner + 1][:, None, :])
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            gt = np.zeros_like(transitions)
            np.add.at(gt, (y[inner], y[inner + 1]), 1.0)
            gt = (gt - pair.sum(axis=0)) / len(inner)
            seen_t += gt * gt
            transitions += 0.1 * gt / np.sqrt(seen_t)
    return weights, transitions


def _known(docs: DataFrame, text_col: str, label_col: str, learn: Column) -> DataFrame:
    return docs.where(learn & F.col(text_col).isNotNull() & F.col(label_col).isNotNull())


def _by_part(sample: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` of the rows of each part.  The sample is dealt by part, one to a task, and stays so: nothing is shuffled."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            for _, rows in pd.concat(held, ignore_index=True).groupby("part"):
                yield fn(rows)

    return sample.mapInPandas(run, schema)


def _chunks(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lo, hi in chunks_by_size(frame["text"].tolist(), size):
            yield frame.iloc[lo:hi]


def _averaged(rows: DataFrame, weights: np.ndarray, transitions: np.ndarray, lexicon: np.ndarray, place: dict[str, int],
              seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights after a pass over all parts side by side, averaged by rows.

    A task holds TRAIN_CHARS at a time.  Spark sums whole numbers, so the order does not matter.
    """
    sent = rows.sparkSession.sparkContext.broadcast((weights, transitions, lexicon))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()
        w, t, lexicon = sent.value
        n, seen = 0, _unseen(len(t))
        for i, chunk in enumerate(_chunks(frames, TRAIN_CHARS)):
            w, t = _train_part(chunk["text"].tolist(), [place[x] for x in chunk["label"]], w, t, lexicon, seed + 1000 * i, seen)
            n += len(chunk)
        if n:
            moved = np.rint(np.concatenate((np.ravel(w), np.ravel(t), [1.0])) * n * UNIT).astype(np.int64)
            at = np.flatnonzero(moved)
            yield pd.DataFrame({"at": at, "moved": moved[at]})

    got = rows.mapInPandas(run, "at long, moved long").groupBy("at").agg(F.sum("moved").alias("moved")).toPandas()
    sent.destroy()
    total = np.zeros(weights.size + transitions.size + 1)
    total[got["at"].to_numpy()] = got["moved"].to_numpy()
    mean = total[:-1] / total[-1]
    return mean[:weights.size].reshape(weights.shape).astype(np.float32), mean[weights.size:].reshape(transitions.shape)


def fit(docs: DataFrame, learn: Column, sample_rows: int | None = SAMPLE_ROWS, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "lang", rounds: int = ROUNDS, evidence: bool = False) -> Model:
    """Fit the model on about ``sample_rows`` (at most twice as many) of the labelled rows where ``learn`` holds.

    The sample is chosen by a hash of the id and the text over the whole table and is all
    that the model sees: labels, lexicon, weights and transitions.  In each
    round PARTS tasks take gradient steps on a share of it from the same
    weights, whose average starts the next round.  What reaches the driver is
    bounded by the model's size and the sample's word list.  With ``evidence``
    the model also holds the sample's features and how the sample's texts fare
    in :func:`identify`, each judged by the features of the other parts.

    ``sample_rows`` None: the sample is all those rows, in as many parts as have
    PART_CHARS each (PARTS at least).  Any number of parts takes all rounds.
    """
    spark = docs.sparkSession
    rows, parts = _known(docs, text_col, label_col, learn), PARTS
    if sample_rows is None:
        chars = rows.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
        parts = max(PARTS, -(-chars // PART_CHARS))
    else:
        rows = bounded_sample(rows, F.struct(id_col, text_col), sample_rows, "langid")
    sample = (rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                          F.col(label_col).cast("string").alias("label"))
              .withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int"))
              .repartitionById(parts, F.col("part")))
    if sample_rows is None:
        sample = sample.sortWithinPartitions("part", F.xxhash64("text", "id"), "id", "text", "label")
    sample = sample.persist()
    try:
        labels = sorted(r[0] for r in sample.select("label").distinct().collect())
        n = len(labels)
        if not n:
            return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.empty(0, np.uint64))
        word = F.explode(F.split(F.lower("text"), r"\s+"))
        frequent = (sample.select(word.alias("word")).groupBy("word").count().where("count >= 3")
                    .orderBy(F.desc("count"), "word").limit(LEXICON).select("word").collect())
        names = sorted({w for w in (clean(r[0]) for r in frequent) if w})
        lexicon = np.empty(0, np.uint64)
        if names:
            marked = "".join("\x02" + w + "\x03" for w in names)
            codes = np.frombuffer(marked.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
            lexicon = np.unique(whole_hashes(codes, np.fromiter(map(len, names), np.int64) + 2))
        place = {label: k for k, label in enumerate(labels)}
        weights, transitions = np.zeros((BUCKETS, n), np.float32), np.zeros((n, n))
        for r in range(rounds):
            if sample_rows is None:
                weights, transitions = _averaged(sample, weights, transitions, lexicon, place, 7 + r)
                continue
            sent = spark.sparkContext.broadcast((weights, transitions, lexicon))

            def run(rows: pd.DataFrame) -> pd.DataFrame:
                rows = rows.sort_values(["id", "text"])
                w, t = _train_part(rows["text"].tolist(), [place[x] for x in rows["label"]], *sent.value, 7 + r)
                return pd.DataFrame({"rows": [len(rows)], "w": [w.astype("<f4").tobytes()],
                                     "t": [t.astype("<f8").tobytes()]})

            got = (_by_part(sample, run, "rows long, w binary, t binary")
                   .orderBy("rows", F.md5("w")).collect())
            share = [g["rows"] / sum(x["rows"] for x in got) for g in got]
            weights = sum(s * np.frombuffer(g["w"], "<f4").reshape(BUCKETS, n) for s, g in zip(share, got))
            transitions = sum(s * np.frombuffer(g["t"], "<f8").reshape(n, n) for s, g in zip(share, got))
            sent.destroy()
        model = Model(labels, weights.astype(np.float32), transitions, lexicon)
        if not evidence:
            return model
        return _calibrated_on_all(model, sample) if sample_rows is None else _calibrated(model, sample)
    finally:
        sample.unpersist()


def _calibrated(model: Model, sample: DataFrame) -> Model:
    """The model with the features of the sample and the calibration on its texts."""
    def used(rows: pd.DataFrame) -> pd.DataFrame:
        words = {w for t in rows["text"] for w in map(clean, t.lower().split()) if w}
        seen = np.zeros(BUCKETS, bool)
        seen[features(sorted(words), model.lexicon)[0]] = True
        return pd.DataFrame({"part": rows["part"].iloc[:1], "seen": [np.packbits(seen).tobytes()]})

    own = {r["part"]: np.unpackbits(np.frombuffer(r["seen"], np.uint8)).astype(np.int64)
           for r in _by_part(sample, used, "part int, seen binary").collect()}
    total = sum(own.values())

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        label = Labeller(replace(model, seen=total > own[rows["part"].iloc[0]]))
        _, scores, _ = label(rows["text"].tolist(), False)
        out = pd.DataFrame({"known": label.known_share, "score": scores})
        return out[label.n_words > 0]

    model = replace(model, seen=total > 0)
    got = _by_part(sample, judge, "known double, score double").toPandas()
    if len(got) < LEAST_TEXTS:
        return model
    known, score = (float(np.percentile(got[c], LOWEST)) for c in ("known", "score"))
    return replace(model, low_known=known, low_score=score)


def _calibrated_on_all(model: Model, rows: DataFrame) -> Model:
    """:func:`_calibrated` over any number of parts; the texts of a fold (part mod PARTS) are judged by those of the others.

    Features and percentiles are of all rows: bits are joined and texts counted by step of GRID in Spark.
    """
    def used(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, fold = np.zeros(BUCKETS, bool), None
        for chunk in _chunks(frames, TRAIN_CHARS):
            words = {w for t in chunk["text"] for w in map(clean, t.lower().split()) if w}
            seen[features(sorted(words), model.lexicon)[0]] = True
            fold = int(chunk["part"].iloc[0]) % PARTS
        if fold is not None:
            bits = np.packbits(seen).view("<i8")
            yield pd.DataFrame({"fold": fold, "at": np.arange(len(bits)), "bits": bits})

    got = rows.mapInPandas(used, "fold int, at int, bits long").groupBy("fold", "at").agg(F.bit_or("bits").alias("bits")).collect()
    bits = np.zeros((PARTS, BUCKETS // 64), "<i8")
    for r in got:
        bits[r["fold"], r["at"]] = r["bits"]
    own = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int64)
    total = own.sum(axis=0)
    sent = rows.sparkSession.sparkContext.broadcast((model, own))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_memory()
        label, counts = None, np.zeros((2, GRID + 1), np.int64)
        for chunk in _chunks(frames, GROUP_CHARS):
            if label is None:
                fitted, own = sent.value
                label = Labeller(replace(fitted, seen=own.sum(axis=0) > own[chunk["part"].iloc[0] % PARTS]))
            _, scores, _ = label(chunk["text"].tolist(), False)
            for i, shares in enumerate((label.known_share, scores)):
                counts[i] += np.bincount((shares[label.n_words > 0] * GRID).astype(np.int64), minlength=GRID + 1)
        what, at = np.nonzero(counts)
        yield pd.DataFrame({"what": what, "at": at, "n": counts[what, at]})

    got = rows.mapInPandas(judge, "what int, at int, n long").groupBy("what", "at").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    counts = np.zeros((2, GRID + 1), np.int64)
    for r in got:
        counts[r["what"], r["at"]] = r["n"]
    model = replace(model, seen=total > 0)
    n = int(counts[0].sum())
    if n < LEAST_TEXTS:
        return model
    known, score = (int(np.searchsorted(np.cumsum(c), (n - 1) * LOWEST // 100, side="right")) / GRID for c in counts)
    return replace(model, low_known=known, low_score=score)


# ---------------------------------------------------------------- prediction

class Labeller:
    """Labels texts with a model; keeps the scores of up to CACHE_WORDS distinct tokens."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self):
        self.words = _Words()
        self.scores = np.zeros((0, len(self.model.labels)), np.float32)
        self.letters = np.zeros(0, bool)
        self.known = np.zeros(0)

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self.words) > CACHE_WORDS:
            self._clear()
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        if self.words.new:
            cleaned = [clean(t) for t in self.words.new]
            self.words.new.clear()
            self.scores = np.concatenate((self.scores, emissions(cleaned, self.model.weights, self.model.lexicon)))
            self.letters = np.concatenate((self.letters, np.fromiter(map(bool, cleaned), bool, len(cleaned))))
            if self.model.seen is not None:
                index, owner = features(cleaned, self.model.lexicon)
                share = (np.bincount(owner, self.model.seen[index], minlength=len(cleaned))
                         / np.maximum(np.bincount(owner, minlength=len(cleaned)), 1))
                self.known = np.concatenate((self.known, share))
        return ids

    def __call__(self, texts: list[str | None], spans: bool) -> tuple[list[str], np.ndarray, list | None]:
        labels = self.model.labels
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        self.n_words, self.known_share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        runs: list | None = [[] for _ in texts] if spans else None
        if not labels:
            return names, scores, runs
        split = [t.lower().split() if t else [] for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        ids = self._numbers([w for words in split for w in words])
        p = marginals(self.scores[ids], lengths, self.model.transitions)
        word_of = np.repeat(np.arange(len(texts)), lengths)
        letters = self.letters[ids]
        n = np.bincount(word_of[letters], minlength=len(texts))
        self.n_words = n
        if self.model.seen is not None:
            share = np.bincount(word_of[letters], self.known[ids[letters]], minlength=len(texts)) / np.maximum(n, 1)
            chance = self.model.seen.mean()  # that a feature is known by its bucket alone
            self.known_share = np.maximum(share - chance, 0) / max(1 - chance, 1e-9)
        total = np.stack([np.bincount(word_of[letters], p[letters, k], minlength=len(texts))
                          for k in range(len(labels))], 1)
        best = total.argmax(axis=1)
        for i in np.flatnonzero(n):
            names[i] = labels[best[i]]
            scores[i] = min(1.0, total[i, best[i]] / n[i])
        if spans:
            hard = p.argmax(axis=1)
            turn = np.flatnonzero(np.concatenate(([True], (hard[1:] != hard[:-1]) | (word_of[1:] != word_of[:-1])))) \
                if len(hard) else np.empty(0, np.int64)
            base = np.cumsum(lengths) - lengths
            for lo, hi in zip(turn, np.append(turn[1:], len(hard))):
                i = word_of[lo]
                runs[i].append({"start": int(lo - base[i]), "end": int(hi - base[i]), "lang": labels[hard[lo]]})
        return names, scores, runs


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
             spans: bool = True, evidence: bool = False) -> DataFrame:
    """Language of every whole text: the ``keep`` columns, ``lang_pred``, ``score`` and, if asked for, ``spans``.

    ``lang_pred`` is the label with the largest mean probability over the
    words with a letter (ties: the first label), ``score`` that mean.  A null
    text, a text without a letter and a model without labels give ``und`` and
    0.  ``spans`` are the runs of equally labelled words of a code-switched
    text, [start, end) in white-space separated words.  ``evidence``, of a
    model fitted with it, adds ``n_words`` (words with a letter) and ``known``:
    the mean share of a word's features that the sample has, above what chance
    gives (0 to 1).  One row per input row,
    repeated rows and nulls in any column included; an empty table gives an
    empty result.  Only the text is an input of the prediction; columns other
    than it and ``keep`` are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    table = docs.select(*dict.fromkeys((*keep, text_col)))
    texts_at = table.columns.index(text_col)
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        label = Labeller(sent.value)
        for part in parts:
            texts = part.column(texts_at).to_pylist()
            for lo, hi in chunks_by_size(texts, GROUP_CHARS):
                names, scores, runs = label(texts[lo:hi], spans)
                columns = {c: part.column(i).slice(lo, hi - lo) for i, c in enumerate(keep)}
                columns |= {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}
                if evidence:
                    columns |= {"n_words": pa.array(label.n_words, pa.int64()), "known": pa.array(label.known_share)}
                if spans:
                    columns["spans"] = pa.array(runs, run_type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    found = "lang_pred string, score double" + ", n_words long, known double" * evidence + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return table.mapInArrow(run, T.StructType([table.schema[c] for c in keep] + T.StructType.fromDDL(found).fields))
