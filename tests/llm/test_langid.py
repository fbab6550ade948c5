"""Language ID: forward-backward against enumeration, held-out accuracy, code-switched spans, odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from careops.llm import langid
from careops.llm.queries import QUERIES

from .conftest import frame, odd_rows

MEDIUM = "/root/testdata/sf0.01"
SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["schle", "grund", "ver", "tz"], "cc": ["ção", "lho", "eux", "é"]}


def made(n, rng):
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 80)))
        rows.append((i, text, lang, "s", len(text)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = made(300, random.Random(1))
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
                      F.lit(True))


@pytest.mark.parametrize("steps", [2, 4, 32])
def test_forward_backward_matches_enumeration(monkeypatch, steps):
    monkeypatch.setattr(langid, "STEPS", steps)
    rng = np.random.default_rng(steps)
    lengths = np.array([7, 0, 1, 4, 5])
    scores, tr = rng.normal(size=(lengths.sum(), 3)) * 3, rng.normal(size=(3, 3)) * 2
    got = langid.marginals(scores, lengths, tr)
    at = 0
    for n in lengths:
        own = scores[at:at + n]
        p = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(own[i, y[i]] for i in range(n)) + sum(tr[y[i], y[i + 1]] for i in range(n - 1)))
            for i in range(n):
                p[i, y[i]] += w
        if n:
            assert np.allclose(got[at:at + n], p / p.sum(axis=1, keepdims=True), atol=1e-9)
        at += n


def test_long_texts_do_not_underflow():
    rng = np.random.default_rng(0)
    p = langid.marginals(rng.normal(size=(50_000, 3)) * 30, np.array([50_000]), np.zeros((3, 3)))
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1)


def test_held_out_accuracy(spark):
    got = QUERIES["op1_langid"](spark, MEDIUM).toPandas()
    truth = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got.merge(truth, on="doc_id").query("held_out")
    assert len(got) == len(truth) and 150 < len(held) < 250
    assert (held.lang == held.lang_pred).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_code_switched_text_is_cut_where_it_switches(spark, model):
    rng = random.Random(8)
    parts = [(lang, [rng.choice(SYLLABLES[lang]) + rng.choice(SYLLABLES[lang]) + rng.choice(SYLLABLES[lang]) for _ in range(15)])
             for lang in ("aa", "cc", "bb")]
    text = " ".join(w for _, p in parts for w in p)
    row = langid.identify(frame(spark, [(1, text, None, None, 0)]), model).first()
    assert [(s.start, s.end, s.lang) for s in row.spans] == [(0, 15, "aa"), (15, 30, "cc"), (30, 45, "bb")]
    assert 0.3 < row.score < 0.4


def test_only_the_text_counts(spark, model):
    rows = made(30, random.Random(3))
    mislabelled = [(i + 1000, t, "bb", None, None) for i, t, *_ in rows]
    a = [(r.lang_pred, round(r.score, 9)) for r in langid.identify(frame(spark, rows), model).orderBy("doc_id").collect()]
    b = [(r.lang_pred, round(r.score, 9)) for r in langid.identify(frame(spark, mislabelled), model).orderBy("doc_id").collect()]
    assert a == b and [x[0] for x in a] == [r[2] for r in rows]


def test_held_out_rows_are_not_learned_from(spark):
    rows = made(60, random.Random(5)) + [(1000 + i, "zzq xqz " * 5, "held", "s", 0) for i in range(50)]
    model = langid.fit(frame(spark, rows), F.col("doc_id") < 1000)
    assert model.labels == ["aa", "bb", "cc"]


def test_odd_rows(spark, model):
    got = langid.identify(frame(spark, odd_rows()), model, keep=("doc_id", "rank", "row")).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r.doc_id in (1, 2, 8, 9):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.labels + ["und"] and 0 <= r.score <= 1 and r.rank == r.row == "clash"


def test_nothing_to_learn_from(spark):
    rows = [(1, "text", None, None, None), (2, None, "en", None, None), (None, "text", "en", None, None)]
    model = langid.fit(frame(spark, rows), F.col("doc_id") > 0)
    assert model.labels == []
    got = langid.identify(frame(spark, rows), model).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)} and len(got) == 3
    assert langid.identify(frame(spark, []), model).count() == 0


def test_one_language(spark):
    model = langid.fit(frame(spark, [(i, "only one language here", "en", None, 0) for i in range(5)]), F.lit(True))
    r = langid.identify(frame(spark, [(1, "only here", None, None, 0)]), model).first()
    assert (r.lang_pred, r.score) == ("en", 1.0)


def test_fit_on_all_rows_learns_and_calibrates_on_every_part(spark, monkeypatch):
    rows = made(600, random.Random(3))
    rows += [(600 + i, "zu zu zuzu", "zz", "s", 10) for i in range(2)]  # a label that few rows have
    docs = frame(spark, rows)
    monkeypatch.setattr(langid, "bounded_sample", None)  # nothing is sampled
    monkeypatch.setattr(langid, "PART_CHARS", 8_000)
    m = langid.fit(docs, F.lit(True), sample_rows=None, evidence=True)
    assert m.labels == [*sorted(SYLLABLES), "zz"]
    got = {r["doc_id"]: r for r in langid.identify(docs, m, spans=False, evidence=True).collect()}
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in rows) >= 0.97 * len(rows)
    # features of all texts are known; the limits are low percentiles of all texts
    assert min(r["known"] for r in got.values()) > 0.999
    assert abs(m.low_score - np.percentile([r["score"] for r in got.values()], langid.LOWEST)) < 2e-2
    again = langid.fit(docs.repartition(7), F.lit(True), sample_rows=None, evidence=True)
    assert (again.weights == m.weights).all() and (again.low_known, again.low_score) == (m.low_known, m.low_score)


def test_fit_on_all_rows_takes_every_round_at_any_size(spark, monkeypatch):
    docs, taken = frame(spark, made(300, random.Random(6))), []
    averaged = langid._averaged
    monkeypatch.setattr(langid, "_averaged", lambda rows, *rest: taken.append(rows.rdd.getNumPartitions()) or averaged(rows, *rest))
    for part_chars in (10_000_000, 4_000):
        monkeypatch.setattr(langid, "PART_CHARS", part_chars)
        langid.fit(docs, F.lit(True), sample_rows=None, evidence=True)
    assert len(taken) == 2 * langid.ROUNDS and taken[0] == langid.PARTS < taken[-1]


def test_sequences_are_stretches_of_the_texts():
    texts, labels = ["a1 b c. -- d e f g", "", "!!", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))], [0, 1, 1, 2]
    names, words, gold = langid._sequences(texts, labels, np.random.default_rng(3))
    assert names == sorted(names) and len(words) == len(gold) == 307
    got = [names[i] for i in words]
    assert sorted(got) == sorted(w for t in texts for w in map(langid.clean, t.split()) if w)
    order = {w: i for i, w in enumerate(map(langid.clean, texts[3].split()))}
    long = [order[w] for w, y in zip(got, gold) if y == 2]
    cuts = [b for a, b in zip(long, long[1:]) if b != a + 1]
    assert 300 / 40 - 2 <= len(cuts) <= 300 / 4  # runs of 4 to 40 words, not in their order
    assert langid._sequences([], [], np.random.default_rng(3))[0] == []
