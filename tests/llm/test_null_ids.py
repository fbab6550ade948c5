"""Documents without an id: spread over batches and buckets, with the results that the docstrings state."""

import random
from collections import Counter

from pyspark.sql import functions as F

from careops.llm import mixing, substring, warc

from .conftest import SCHEMA


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))


def test_null_ids_do_not_remove_each_others_words(spark):
    shared, also = text(1), text(2)
    rows = [(None, f"{shared} {text(i, 5)}", None, None, 0) for i in range(10, 40)]
    rows += [(None, also, None, None, 0)] * 3 + [(7, also, None, None, 0), (9, also, None, None, 0)]
    got = substring.remove_repeats(spark.createDataFrame(rows, SCHEMA), batch_chars=500).collect()
    removed = Counter((r.doc_id, r.text is not None and r.text.startswith(shared), r.n_removed) for r in got)
    # nothing goes for what only documents without an id share; they all come after 7
    assert removed == {(None, True, 0): 30, (None, False, 60): 3, (7, False, 0): 1, (9, False, 60): 1}


def test_long_documents_with_neighbouring_ids_get_batches_of_their_own(spark):
    rows = [(i, text(i, 4000 if i in (50, 51, 52, 53) else 10), None, None, 0) for i in range(200)]
    rows += [(300, rows[51][1], None, None, 0)]
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, SCHEMA), batch_chars=20_000).collect()}
    assert len(got) == 201 and got[300].n_removed == 4000 and sum(r.n_removed for r in got.values()) == 4000


def test_null_ids_fill_all_buckets_of_the_mix(spark):
    rows = [(None if i % 3 == 0 else i, text(i, 3), None, "ab"[i % 2], 0) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.monotonically_increasing_id())
    got = mixing.mix(docs, bucket_rows=100, keep=("n",))
    again = mixing.mix(docs.orderBy("text"), bucket_rows=100, keep=("n",))
    assert Counter(got.select("doc_id", "source", "copies").collect()) == Counter(again.select("doc_id", "source", "copies").collect())
    assert got.select("n").distinct().count() == 900
    draws = {r[0] for r in docs.where("doc_id is null").select(
        mixing._draw(F.concat(F.lit(f"{mixing.SEED}:"), "text")) % 9).collect()}
    assert draws == set(range(9))


def test_copies_of_a_payload_stay_out_of_the_shuffle(spark):
    page = "x" * 2000
    rows = [(i, f"http://a/{i}", page if i % 2 else f"{i} {page}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.resolve_roles(pages)
    size = got.agg(F.sum(F.length("payload"))).first()[0]
    assert size == sum(len(r[2]) for r in rows if r[0] % 2 == 0) + 2000
    assert Counter(r.record_type for r in got.collect()) == {"response": 201, "revisit": 199}
    # the partial aggregate sits below the shuffle that carries payloads
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by(payload" in plan


def test_roles_of_repeated_and_missing_ids(spark):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (2, None, "same"), (None, "n1", "same"), (None, "n2", "alone"),
            (None, "n3", "alone"), (3, "u3", None), (4, "u4", "")]
    got = warc.resolve_roles(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert Counter((r.page_id, r.url, r.payload, r.record_type, r.refers_to) for r in got.collect()) == Counter([
        (1, "u1", None, "revisit", 2), (2, "u2", "same", "response", None), (2, None, "same", "response", None),
        (None, "n1", None, "revisit", 2), (None, "n2", "alone", "response", None), (None, "n3", "alone", "response", None),
        (3, "u3", None, "revisit", 4), (4, "u4", "", "response", None)])
