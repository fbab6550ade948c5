"""The corpus pipeline: each stage on its own input, against brute force; the entry module's guard."""

import os
import random
import re
import string
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from careops.llm import mixing

from .conftest import ROOT, SCHEMA, frame, odd_rows
from .test_mix_pack import check_pieces
from .test_text_operators import fingerprint, grouped, kept_words, made_documents, words

MEDIUM = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_columns_and_empty_table(spark):
    none = frame(spark, [])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, none, MEDIUM)
        assert tuple(out.columns) == cp.COLUMNS, name
        assert out.count() == 0
    assert cp.pack_sequences(spark, none, MEDIUM).count() == 0
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "mix_sources", "pack_sequences"]


def test_language_id_drops_what_has_no_language(spark):
    got = rows_of(cp.language_id(spark, frame(spark, odd_rows()), MEDIUM))
    kept = [r for r in odd_rows() if re.search(r"[^\W\d_]", r[1] or "")]
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in sorted(kept, key=str)]
    assert all(r[2] for r in got)  # a null lang is filled
    unlabelled = frame(spark, [(1, "abc", None, None, None)])
    assert rows_of(cp.language_id(spark, unlabelled, MEDIUM)) == [(1, "abc", None, None, None)]


def test_language_id_keeps_the_given_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert cp.language_id(spark, docs, MEDIUM).count() == docs.where("text rlike '[A-Za-z]'").count()


def test_language_id_drops_planted_noise(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rng = random.Random(4)
    noise = [" ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 10)))
                      for _ in range(60)) for _ in range(30)]
    other = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
             "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
             "Minden emberi lény szabadon születik és egyenlő méltósága és joga van",
             "Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由 在尊严和权利上一律平等"]
    rows = [(10_000_000 + 5 * i, t, None, "s", len(t)) for i, t in enumerate(noise + other)]
    planted = docs.select(*cp.COLUMNS).union(spark.createDataFrame(rows, SCHEMA))
    got = cp.language_id(spark, planted, MEDIUM)
    assert got.where("doc_id >= 10000000").count() == 0
    assert got.count() == docs.where("text rlike '[A-Za-z]'").count()


@pytest.mark.parametrize("rows", ["odd", "made"])
def test_near_dedup_keeps_one_of_each_group(spark, rows):
    rows = odd_rows() if rows == "odd" else made_documents()
    least = grouped([(r[0], fingerprint(r[1])) for r in rows], 3)
    expected = {r for i, r in enumerate(rows) if r[0] == least[i]}
    assert rows_of(cp.simhash_near_dedup(spark, frame(spark, rows), MEDIUM)) == sorted(expected, key=str)


@pytest.mark.parametrize("rows", ["odd", "made"])
def test_substring_dedup_cuts_the_texts(spark, rows):
    rows = odd_rows() if rows == "odd" else made_documents()
    got = cp.substring_dedup(spark, frame(spark, rows), MEDIUM).collect()
    assert sorted(((r.doc_id, tuple(words(r.text))) for r in got), key=str) == sorted(
        ((i, k) for i, _, _, k in kept_words(rows, 13)), key=str)
    before = {(r[0], r[1]): r for r in rows}
    for r in got:
        if (r.doc_id, r.text) not in before:
            assert r.n_chars == len(r.text)
        else:
            assert r.n_chars == before[r.doc_id, r.text][4] or before[r.doc_id, r.text][4] in (0, 1)


def test_mix_emits_each_document_as_often_as_planned(spark):
    rows = odd_rows() + made_documents()
    df = frame(spark, rows)
    plan = {r.doc_id: r.n for r in mixing.mix(df).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    got = rows_of(cp.mix_sources(spark, df, MEDIUM))
    assert set(got) <= set(rows)
    for i, n in plan.items():
        assert sum(r[0] == i for r in got) == n


def test_pack_round_trip(spark):
    rows = made_documents(40)
    check_pieces(rows, cp.pack_sequences(spark, frame(spark, rows), MEDIUM).collect(), 2048)


def test_run_feeds_each_stage_to_the_next(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, MEDIUM).toPandas().astype(object).values.tolist(), SCHEMA) \
            if stage is not cp.pack_sequences else stage(spark, docs, MEDIUM)
    def tokens(df):
        return df.groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert rows_of(tokens(cp.run(spark, MEDIUM))) == rows_of(tokens(docs))


def test_entry_module_without_the_subpackage(tmp_path):
    """With the folders gone the entry module still imports; an error inside them is not hidden."""
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "careops", ".git"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    (tmp_path / "careops").mkdir()
    for name in os.listdir(f"{ROOT}/careops"):
        if name != "llm":
            os.symlink(f"{ROOT}/careops/{name}", tmp_path / "careops" / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), [k for k in q if k.startswith('op')], 'pipeline' in q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-B", "-c", code.replace("import __spark", "import sys; sys.path.insert(0, '.'); import __spark")],
                          cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0 and done.stdout.split(" ", 1)[1] == "[] False\n", done.stderr
    (tmp_path / "corpus_pipeline.py").write_text("import module_that_is_not_there\n")
    (tmp_path / "careops" / "llm").mkdir()
    for name in os.listdir(f"{ROOT}/careops/llm"):
        os.symlink(f"{ROOT}/careops/llm/{name}", tmp_path / "careops" / "llm" / name)
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode and "module_that_is_not_there" in done.stderr


def test_language_id_samples_nothing(spark, monkeypatch):
    from careops.llm import langid

    def sampled(*_):
        raise AssertionError("a sample")
    monkeypatch.setattr(langid, "bounded_sample", sampled)
    assert cp.language_id(spark, frame(spark, odd_rows()), MEDIUM).count()
