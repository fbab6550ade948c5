"""Distributed exact order statistics against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from careops.functions import ranks


@pytest.fixture(params=["single", "bucketed"])
def path(request, monkeypatch):
    if request.param == "bucketed":
        monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 10)
    return request.param


def test_percentiles_match_numpy(spark, path):
    rnd = random.Random(7)
    vals = [rnd.choice([1.0, 2.0, 2.0, 7.0, None]) for _ in range(300)] + [rnd.random() * 50 for _ in range(700)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "x double, g int")
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]
    got = ranks.percentile_values(df, "x", probs)
    want = np.percentile(np.array([v for v in vals if v is not None]), [p * 100 for p in probs])
    assert np.allclose(got, want, rtol=0, atol=1e-12)
    grouped = ranks.exact_percentiles(df, "x", [0.5], ["g"]).collect()
    for r in grouped:
        sub = [v for i, v in enumerate(vals) if v is not None and i % 3 == r.g]
        assert abs(r.value - np.percentile(sub, 50)) < 1e-12


def test_kth_key_and_lexicographic_cut(spark, path):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 9), rnd.randint(0, 3), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    srt = sorted(rows)
    for k in (1, 2, 250, 499, 500):
        key = ranks.kth_key(df, ["a", "b", "c"], k)
        assert tuple(key) == srt[k - 1]
        assert df.where(ranks.lex_leq([F.col("a"), F.col("b"), F.col("c")], key)).count() == k
    assert ranks.kth_key(df, ["a"], 0) is None


def _brute_ks(a, b):
    pts = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in pts)


def test_ks_statistic_properties(spark, path):
    a = [float(x % 17) for x in range(200)]
    b = [float((x * 3) % 23) for x in range(150)]
    da = spark.createDataFrame([(x,) for x in a], "v double")
    db = spark.createDataFrame([(x,) for x in b], "v double")
    d = ranks.ks_statistic(da, db, "v").first()
    assert abs(d.d - _brute_ks(a, b)) < 1e-12
    assert ranks.ks_statistic(da, da, "v").first().d == 0.0
    far = spark.createDataFrame([(x + 1000.0,) for x in a], "v double")
    assert ranks.ks_statistic(da, far, "v").first().d == 1.0
    back = ranks.ks_statistic(db, da, "v").first().d
    assert abs(back - d.d) < 1e-12


def _exact_cdf(n, d):
    """P(D_n < d) by the matrix of Marsaglia, Tsang and Wang (2003)."""
    k = int(n * d) + 1
    size, h = 2 * k - 1, k - n * d
    a = np.array([[1.0 if i - j + 1 >= 0 else 0.0 for j in range(size)] for i in range(size)])
    for i in range(size):
        a[i, 0] -= h ** (i + 1)
        a[-1, i] -= h ** (size - i)
    a[-1, 0] += (2 * h - 1) ** size if 2 * h > 1 else 0
    for i in range(size):
        for j in range(size):
            if i - j + 1 > 0:
                a[i, j] /= math.factorial(i - j + 1)
    p, scale = np.eye(size), 0
    for i in range(n):
        p = p @ a * (i + 1) / n  # times n! / n**n in the end
    return p[k - 1, k - 1]


def test_kolmogorov_pvalue_matches_the_exact_distribution(spark):
    cases = [(n, d) for n in (140, 400) for d in (0.03, 0.05, 0.07, 0.1, 0.13)]
    rows = [(d, 2.0 * n, 2.0 * n) for n, d in cases]  # two samples of 2n: effective size n
    df = spark.createDataFrame(rows, "d double, n double, m double")
    got = df.select("d", "n", ranks.kolmogorov_pvalue(F.col("d"), F.col("n"), F.col("m")).alias("p"))
    limit = {140: 5e-6, 400: 1e-6}  # the expansion is good to five digits at 140 and gains with the size
    for r in got.collect():
        assert abs(r.p - (1 - _exact_cdf(int(r.n / 2), r.d))) < limit[int(r.n / 2)]


def test_kolmogorov_pvalue_published_row(spark):
    # the published LoS row: D 0.0143 (rounded) with 20,000 and 5,000 rows, p 0.383088
    df = spark.createDataFrame([(x, 20000.0, 5000.0) for x in (0.01425, 0.01435, 0.0, 0.5)], "d double, n double, m double")
    p = [r.p for r in df.select(ranks.kolmogorov_pvalue(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()]
    assert p[1] < 0.383088 < p[0] and p[0] - p[1] < 0.01 and p[2:] == [1.0, 0.0]


def test_null_groups_are_groups(spark, path):
    rows = [(g, float(v)) for g in ("a", None, "b") for v in range(100)]
    df = spark.createDataFrame(rows, "g string, v double")
    cum = ranks.cumulative_counts(df, "v", None, ["g"]).collect()
    assert len(cum) == 300 and sorted(r.cum_n for r in cum if r.g is None) == list(range(1, 101))
    got = {r.g: r.value for r in ranks.exact_percentiles(df, "v", [0.5], ["g"]).collect()}
    assert got == {"a": 49.5, None: 49.5, "b": 49.5}


def test_kth_key_of_repeated_rows(spark, path):
    df = spark.createDataFrame([(1, 2, 3)] * 400 + [(1, 2, 4)] * 3, "a long, b long, c long")
    assert ranks.kth_key(df, ["a", "b", "c"], 400) == [1, 2, 3]
    assert ranks.kth_key(df, ["a", "b", "c"], 401) == [1, 2, 4]


def _enumerated(n, m, d):
    """P(D >= d) over all ways in which two samples can interleave."""
    import itertools
    hits = total = 0
    for ones in itertools.combinations(range(n + m), n):
        chosen, i, worst = set(ones), 0, 0.0
        for k in range(n + m):
            i += k in chosen
            worst = max(worst, abs(i / n - (k + 1 - i) / m))
        total += 1
        hits += worst >= d - 1e-12
    return hits / total


def test_exact_pvalue_matches_enumeration(spark):
    cases = [(n, m, k / (n * m)) for n, m in ((3, 3), (4, 6), (7, 5), (1, 8)) for k in range(1, n * m + 1, 3)]
    df = spark.createDataFrame([(d, n, m) for n, m, d in cases], "d double, n long, m long")
    got = df.select("d", "n", "m", ranks.ks_pvalue(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()
    assert len(got) == len(cases)
    for r in got:
        assert abs(r.p - _enumerated(r.n, r.m, r.d)) < 1e-12


def test_pvalue_joins_the_expansion(spark):
    # just below and above the size where the exact distribution ends
    df = spark.createDataFrame([(0.02, 10_000, 10_000), (0.02, 10_001, 10_001), (0.0135, 10_000, 9_000)], "d double, n long, m long")
    rows = df.select(ranks.ks_pvalue(F.col("d"), F.col("n"), F.col("m")).alias("p"),
                     ranks.kolmogorov_pvalue(F.col("d"), F.col("n").cast("double"), F.col("m").cast("double")).alias("q")).collect()
    assert abs(rows[0].p - rows[1].p) < 2e-3 and rows[1].p == rows[1].q and abs(rows[0].p - rows[0].q) < 2e-3


def test_plan_does_not_grow_with_the_buckets(spark):
    df = spark.range(60_000).select(F.col("id").cast("double").alias("v"))

    def size(buckets):
        cum = ranks.cumulative_counts(df, "v", buckets=buckets)
        assert cum.agg(F.max("cum_n")).first()[0] == 60_000
        return len(cum._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(500) - size(8)) < 200
