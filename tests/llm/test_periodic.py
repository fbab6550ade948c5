"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from careops.llm import periodic, queries

from .conftest import SCHEMA, frame, odd_rows


def longest_lyndon(x):
    out = []
    for i in range(len(x)):
        j = i + 1
        while j < len(x) and x[i:] < x[j:]:
            j += 1
        out.append(j - i)
    return out


def all_runs(x, least):
    """Every (start, length, period) by trying all periods, smallest periods first."""
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            start, length = i, j + q - i
            i = j + 1 if j == i else j
            if length >= max(least, 2 * q) and not any(
                    all(x[k] == x[k + p] for k in range(start, start + length - p)) for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, k = rng.randint(1, 45), rng.randint(1, 4)
        x = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5:
            p = rng.randint(1, max(1, n // 2))
            x = [x[i % p] for i in range(n)]
            x[rng.randrange(n)] = rng.randrange(k)
        values = sorted(set(x))
        yield [values.index(v) for v in x]


def test_lyndon_array_of_both_orders():
    for x in sequences(1, 400):
        assert periodic.lyndon_array(np.array(x)).tolist() == longest_lyndon(x)
        turned = [max(x) - v for v in x]
        assert periodic.lyndon_array(np.array(turned)).tolist() == longest_lyndon(turned)


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_match_brute_force(least):
    for x in sequences(least, 400):
        assert [tuple(r) for r in periodic.runs(np.array(x), least).tolist()] == all_runs(x, least)


def test_fibonacci_and_square_free_words():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert [tuple(r) for r in periodic.runs(np.array(b), 2).tolist()] == all_runs(b, 2)
    word = [0]
    while len(word) < 300:  # a word without squares
        word = [v for c in word for v in ([0, 1, 2], [0, 2], [1])[c]]
    assert len(periodic.runs(np.array(word), 2)) == 0


def expected(doc_id, text):
    """The query's row for one document, by brute force."""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words, 12)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    text = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    milli = 1000 * best[1] // best[2] if found else None
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, milli, hashlib.sha256(text.encode()).hexdigest(),
            hashlib.sha256(kept.encode()).hexdigest())


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        words = [rng.choice(["a", "b", "la", "é", "x."]) for _ in range(rng.randint(0, 60))]
        if i % 4 == 0:
            words = words[:5] * rng.randint(1, 9) + words[5:9] + words[:2] * 9
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), None, None, 0))
    rows += [r for r in odd_rows() if r[1] is None or len(r[1]) < 1000]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    key = repr
    assert sorted((tuple(r) for r in got), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)
    assert any(r[1] > 1 for r in map(tuple, got))


def test_operator_keeps_rows_and_columns(spark):
    rows = odd_rows() + [(20, "tick tock " * 30_000, None, "z", 0)]
    got = periodic.periodic_runs(frame(spark, rows), keep=("source",)).collect()
    assert len(got) == len(rows)
    long = [r for r in got if r.doc_id == 20]
    assert [tuple(x) for x in long[0].runs] == [(0, 60_000, 2)] and long[0].collapsed == "tick tock"
    assert long[0].source == "z"
    assert {r.collapsed for r in got if r.doc_id == 2} == {""}
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
