"""Language-model scores: counts against brute force, a probability model, odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from careops.llm import lm
from careops.llm.queries import QUERIES

from .conftest import frame, odd_rows

MEDIUM = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def check_base(rows, learned, got):
    counts = collections.Counter(t for i, text in rows if learned(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((i, len(t := tokens(text)), sum(counts[w] > 0 for w in t), n,
                        round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for i, text in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == expected


@pytest.mark.parametrize("sent", [200_000, 50])
def test_base_scores_match_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(lm, "SENT_WORDS", sent)  # 50: most words take the way over the join
    got = QUERIES["op8_lm_scoring"](spark, MEDIUM).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    check_base(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, got)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    # the model uses the context: better than the base on texts it has not seen
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.9


def test_odd_rows(spark):
    got = lm.fit_and_score(frame(spark, odd_rows()), F.col("doc_id") != 3).collect()
    check_base([(r[0], r[1]) for r in odd_rows()], lambda i: i is not None and i != 3, got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_nothing_to_learn_from(spark):
    got = lm.fit_and_score(frame(spark, odd_rows()), F.lit(False)).collect()
    assert len(got) == len(odd_rows()) and {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    assert lm.fit_and_score(frame(spark, []), F.lit(True)).count() == 0


def test_token_probabilities_sum_to_one():
    """Over all known words and one unknown per class, in any context."""
    rng = np.random.default_rng(2)
    classes = rng.integers(0, lm.CLASSES, lm.ENDINGS)
    weights = rng.normal(size=(lm.BUCKETS, lm.CLASSES)).astype(np.float32)
    counts = {c: rng.integers(1, 9, 5) for c in range(lm.CLASSES)}
    t = lm.Tokens(["one two three two one", "", "four"])
    logits = lm._logits(weights, np.zeros(lm.CLASSES, np.float32), t.features(classes))
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    share = [sum((n + 1) / (counts[c].sum() + 5 + 1) for n in counts[c]) + 1 / (counts[c].sum() + 5 + 1) for c in counts]
    assert np.allclose((p * share).sum(axis=1), 1, atol=1e-5)


def test_cell_probabilities_sum_to_one_for_every_class():
    """Class, cell and share together are a distribution over the known words and one unknown for each cell."""
    rng = np.random.default_rng(3)
    classes = rng.integers(0, lm.CLASSES, lm.ENDINGS)
    weights = lm.Weights.of(1 << 10)
    for table in (weights.classes, weights.cells):
        table += rng.normal(size=table.shape).astype(np.float32)
    model = lm.Model(classes, weights, np.zeros((lm.CLASSES, lm.CELLS)), np.empty(0, np.uint64), np.empty(0))
    t = lm.Tokens(["one two three"])
    total = np.zeros(len(t.ending))
    by_class = [int(np.flatnonzero(classes == c)[0]) for c in np.unique(classes)]
    for ending in by_class:  # the token itself gets any class and cell; its context stays
        for cell in range(lm.CELLS):
            for i in range(len(t.ending)):
                u = lm.Tokens(["one two three"])
                u.ending[i], u.cell[i] = ending, cell
                total[i] += 10 ** lm.token_logs(model, u)[i]
    assert np.allclose(total, 1, atol=1e-5)


def test_scores_do_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHARS_A_ROW", 40)  # several shares
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string")) % 7
    learned, scores = rest != 2, []
    for n in (1, 8, 64):
        got = lm.fit_and_score(docs.repartition(n), learned).collect()
        scores.append({r.doc_id: (r.score, r.base_score) for r in got})
    held = [i for i in scores[0] if zlib.crc32(str(i).encode()) % 7 == 2]
    for other in scores[1:]:
        assert all(abs(other[i][0] - s[0]) <= 1e-6 * abs(s[0]) for i, s in scores[0].items())
    assert sum(scores[0][i][0] for i in held) > 0.96 * sum(scores[0][i][1] for i in held)


def test_fitted_scores_match_a_recomputation(spark, monkeypatch):
    """The scores of a fitted model, text by text, from its own tables and counts."""
    kept = []
    make = lm._score_batches
    monkeypatch.setattr(lm, "_score_batches", lambda sent: kept.append(sent.value) or make(sent))
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "Efg", "hij", "k"]) for _ in range(rng.randint(0, 30))), None, None, 0) for i in range(300)]
    got = {r.doc_id: r.score for r in lm.fit_and_score(frame(spark, rows), F.col("doc_id") % 7 != 2).collect()}
    m = kept[0]
    learned = [t for i, text, *_ in rows if i % 7 != 2 for t in tokens(text)]
    counts = collections.Counter(learned)
    sizes = collections.Counter()
    for word, n in counts.items():
        t = lm.Tokens([word or ""])
        sizes[int(m.classes[t.ending[0]]), int(t.cell[0])] += n + 1
    for i, text, *_ in rows:
        t, total = lm.Tokens([text]), 0.0
        rows1, rows2 = t.features(m.classes, m.weights.buckets), t.cell_features(m.classes, m.weights.buckets)
        for k, word in enumerate(tokens(text)):
            c, cell = int(m.classes[t.ending[k]]), int(t.cell[k])
            x = m.weights.classes[rows1[k]].sum(0).astype(float) + m.weights.classes[-1]
            y = m.weights.cells[rows2[k]].sum(0).astype(float)
            p = math.exp(x[c]) / np.exp(x).sum() * math.exp(y[cell]) / np.exp(y).sum()
            total += math.log10(p * (counts[word] + 1) / (sizes[c, cell] + 1))
        assert got[i] == pytest.approx(total, rel=1e-5)


def test_context_does_not_cross_texts():
    a, b = lm.Tokens(["x y z", "p q"]), lm.Tokens(["p q"])
    classes = np.arange(lm.ENDINGS) % lm.CLASSES
    assert (a.features(classes)[-3:] == b.features(classes)).all()
    assert a.n_tokens.tolist() == [4, 3] and a.hash[3] == lm.END


def test_gradient_steps_learn_the_context(spark):
    """Words of two kinds that alternate in runs: the next one's kind follows from the last one's."""
    rng = random.Random(1)
    runs = [" ".join(f"{k}{rng.randint(0, 50)}{k}" for _ in range(40)) for k in ("aa", "bb") for _ in range(1000)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(runs)]
    got = lm.fit_and_score(frame(spark, rows), F.col("doc_id") % 5 != 0).where("doc_id % 5 = 0").collect()
    assert sum(r.score for r in got) / sum(r.base_score for r in got) < 0.95
